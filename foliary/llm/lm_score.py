"""LM scoring (3): n-gram counts quantised by logarithm in a Bloom filter that is broadcast to the workers.

Texts become words' hashes once, in chunks of a few MB. Words and pairs of words of all training texts are counted by
ranges of their hash. A pair of count c enters the filter once for each level 1 .. 1 + floor(log_B c); a reader asks for
level after level until one is missing, and takes the middle of the last level's counts. The filter holds every pair
that was counted, in segments, one for each range, as large as their pairs need. Within a bound of bytes all segments
are broadcast; beyond it each chunk's distinct pairs go to the segments of their ranges instead, and the levels come
back to the chunk. Both ways probe the same bits, so a score doesn't depend on the way. Words' counts, which the base
score needs exactly, come back the same way, and pairs are smoothed with them by a Dirichlet prior.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import textops
from foliary.llm.common import remove, table, written

#: Base of the levels, bits for each entry and probes, bytes of a filter that is broadcast, tokens gathered before a
#: task hands them on, bytes of text for each range, weight of the word prior.
LEVEL, BITS, PROBES, FILTER_BYTES, FLUSH, RANGE_BYTES, PRIOR = 1.5, 10, 5, 1 << 23, 3_000_000, 1 << 24, 2000.0
END_HASH, START_HASH = 0x5EED0E4D, 0x5EED057A
CHUNKS = "chunk long, ids array<long>, held array<boolean>, ends array<int>, words binary, places binary"
PACKED = "part int, words binary, word_counts binary, pairs binary, pair_counts binary"
COUNTED = "part int, n long, distinct long, words binary, counts binary, size long, segment binary"
ASKED, ANSWERED = "part int, chunk long, words binary, pairs binary", "part int, chunk long, counts binary, levels binary"
SCORED = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 7, is 2; a null id is training text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end at each text's end, and the ends of the texts."""
    hashes, words = textops.word_hashes(column)
    ends = words[1:] + np.arange(1, len(words))
    return np.insert(hashes, words[1:], np.uint64(END_HASH)), ends


def pairs(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it, or with the start of its text. 56 bits, so a byte less moves."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.concatenate([[0], ends[:-1]])] = START_HASH
    return textops.mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes) & ~np.uint64(0xFF)


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: high bytes of sorted hashes and of small numbers compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def joined(raw: bytes | pa.Buffer, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return (grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def cuts_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of sorted grams starts, and the end of the last."""
    return np.searchsorted(part_of(grams, parts), np.arange(parts + 1))


def _chunks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held, text) as chunks: the distinct word hashes in order, and the place of each token's among them."""
    number = TaskContext.get().partitionId() << 32
    for batch in textops.batches(source):
        hashes, ends = tokens(batch.column(2))
        words, places = np.unique(hashes, return_inverse=True)
        one = pa.array([0, batch.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(one, c) for c in (batch.column(0), batch.column(1), pa.array(ends, pa.int32()))]
        yield pa.record_batch([pa.array([number], pa.int64()), *lists, pa.array([planes(words)], pa.binary()), pa.array([planes(places.astype("<u4"))], pa.binary())], names=["chunk", "ids", "held", "ends", "words", "places"])
        number += 1


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct words, each token's place among them, and the texts' ends."""
    return joined(row["words"], "<u8"), joined(row["places"], "<u4"), np.array(row["ends"], np.int64)


def merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order with the sums of their counts."""
    if not len(grams):
        return grams, counts.astype(np.int64)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[start], np.add.reduceat(counts[order].astype(np.int64), start)


def _gather(parts: int):
    """Counts of the training words and pairs of a few million tokens at a time, packed by range."""

    def flush(words: list, seen: list) -> Iterator[pa.RecordBatch]:
        own = merged(np.concatenate([w for w, _ in words]), np.concatenate([c for _, c in words]))
        two = np.unique(np.concatenate(seen), return_counts=True)
        at, to = cuts_of(own[0], parts), cuts_of(two[0], parts)
        for p in range(parts):
            (a, b), (c, d) = at[p : p + 2], to[p : p + 2]
            if b > a or d > c:
                packed = (planes(own[0][a:b]), planes(own[1][a:b].astype("<u4")), planes(two[0][c:d]), planes(two[1][c:d].astype("<u4")))
                yield pa.record_batch([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["part", "words", "word_counts", "pairs", "pair_counts"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, total = [], [], 0
        for row in _rows(source):
            known, places, ends = _opened(row)
            learned = np.repeat(~np.array(row["held"], bool), np.diff(ends, prepend=0))
            counts = np.bincount(places[learned], minlength=len(known))
            words.append((known[counts > 0], counts[counts > 0]))
            seen.append(pairs(known[places], ends)[learned])
            total += len(seen[-1])
            if total >= FLUSH:
                yield from flush(words, seen)
                words, seen, total = [], [], 0
        if total:
            yield from flush(words, seen)

    return run


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a chunk is large, a batch of them need not fit in memory as Python values."""
    for batch in source:
        for k in range(batch.num_rows):
            yield {n: c[k].as_buffer() if pa.types.is_binary(c.type) else c[k].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
    # A worker outlives its tasks: what Arrow's pool holds but no longer uses goes back.
    pa.default_memory_pool().release_unused()


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(LEVEL) + 1e-9).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of those in it, 0 for none."""
    return np.where(level > 0, np.maximum(1.0, (LEVEL ** (level - 1.0) + LEVEL**level) / 2 - 0.25), 0.0)


def _slots(grams: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    h = textops.mix(grams + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64)))
    step = textops.mix(h) | np.uint64(1)
    for k in range(PROBES):
        yield (h + np.uint64(k) * step >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)


def build_segment(grams: np.ndarray, counts: np.ndarray, each: int = BITS) -> np.ndarray:
    """The bits of a segment that holds all the grams, with ``each`` bits for an entry."""
    level = levels(counts)
    bits = 8 * (int(level.sum()) * each // 8 + 8)
    out = np.zeros(bits, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        some = grams[level >= k]
        for a in range(0, len(some), 1 << 18):
            for slot in _slots(some[a : a + (1 << 18)], k, bits):
                out[slot] = True
    return np.packbits(out, bitorder="little")


def probe(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The level of each gram of a segment's range by repeated membership probes."""
    out = np.zeros(len(grams), np.uint8)
    live, level = np.arange(len(grams)), 1
    while len(live) and len(bits):
        found = np.ones(len(live), bool)
        for slot in _slots(grams[live], level, len(bits) * 8):
            found &= bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
        live = live[found]
        out[live] = level
        level += 1
    return out


def probe_all(segments: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams), np.uint8)
    part = part_of(grams, len(segments))
    order = np.argsort(part.astype(np.uint16) if len(segments) < 1 << 16 else part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(len(segments) + 1))
    for p, bits in enumerate(segments):
        own = order[cuts[p] : cuts[p + 1]]
        out[own] = probe(bits, grams[own])
    return out


def _reduce(each: int):
    """The exact counts of a range's words and the segment of its pairs."""

    def run(rows: pa.Table) -> pa.Table:
        words, two = merged(*_column(rows, "words", "word_counts")), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held, waiting = [], 0
        for k in range(rows.num_rows):
            held.append(_column(rows.slice(k, 1), "pairs", "pair_counts"))
            waiting += len(held[-1][0])
            # Merged from time to time, so memory follows the distinct pairs.
            if waiting > max(FLUSH, len(two[0])) or k == rows.num_rows - 1:
                two = merged(*(np.concatenate([two[i], *(x[i] for x in held)]) for i in (0, 1)))
                held, waiting = [], 0
        bits = build_segment(*two, each)
        values = (rows.column("part")[0].as_py(), int(words[1].sum()), len(words[0]), words[0].tobytes(), words[1].astype("<i8").tobytes(), len(bits), bits.tobytes())
        names, kinds = ("part", "n", "distinct", "words", "counts", "size", "segment"), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
        return pa.table({n: pa.array([v], kind) for n, v, kind in zip(names, values, kinds, strict=True)})

    return run


def _column(rows: pa.Table, grams: str, counts: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([joined(x.as_buffer(), kind) for x in rows.column(c)]) for c, kind in ((grams, "<u8"), (counts, "<u4")))


def _ask(parts: int, with_pairs: bool):
    """The distinct words, and where asked for pairs, of each chunk by range. No gram is more than once in a chunk's."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(source):
            words, places, ends = _opened(row)
            two = np.unique(pairs(words[places], ends)) if with_pairs else np.zeros(0, np.uint64)
            at, to = cuts_of(words, parts), cuts_of(two, parts)
            some = np.flatnonzero((np.diff(at) > 0) | (np.diff(to) > 0))
            columns = [pa.array([planes(x[c[p] : c[p + 1]]) for p in some], pa.binary()) for x, c in ((words, at), (two, to))]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(np.full(len(some), row["chunk"])), *columns], names=["part", "chunk", "words", "pairs"])

    return run


def _answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """The counts of the words and the levels of the pairs that the chunks ask of one range."""
    have = counted.num_rows > 0
    known, counts, bits = (np.frombuffer(counted.column(n)[0].as_py(), kind) if have else np.zeros(0, kind) for n, kind in (("words", "<u8"), ("counts", "<i8"), ("segment", "u1")))
    out = {"counts": [], "levels": []}
    for words, two in zip(asked.column("words"), asked.column("pairs"), strict=True):
        words = joined(words.as_buffer(), "<u8")
        place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
        out["counts"].append(planes((np.where(known[place] == words, counts[place], 0) if len(known) else np.zeros(len(words), np.int64)).astype("<i8")))
        out["levels"].append(probe(bits, joined(two.as_buffer(), "<u8")).tobytes())
    return pa.table({"part": asked.column("part"), "chunk": asked.column("chunk")} | {k: pa.array(v, pa.binary()) for k, v in out.items()})


def _score(total: int, distinct: int, trained: int, prior: float, segments: Callable[[], list[np.ndarray]] | None):
    """The scores of a chunk's rows from the answers of all ranges, which follow the order of its grams."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(_rows(rows.combine_chunks().to_batches()))
        answers = answers.sort_by("part")
        words, places, ends = _opened(row)
        counts = np.concatenate([joined(x.as_buffer(), "<i8") for x in answers.column("counts")])[places]
        two = pairs(words[places], ends)
        if segments is not None:
            level = probe_all(segments(), two)
        else:
            level = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)[np.unique(two, return_inverse=True)[1]]
        # N + 1 * (V + 1) tokens of weight, one of them for all words not seen.
        mass = total + distinct + 1
        n = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(n)), n)
        history = np.empty(len(counts))
        history[1:] = counts[:-1]
        history[ends - n] = trained
        both = np.minimum(middle(np.arange(256))[level], np.minimum(history, counts))
        score = np.bincount(doc, np.log10((both + prior * (counts + 1) / mass) / (history + prior)), len(n))
        base = np.bincount(doc, np.log10((counts + 1) / mass), len(n))
        known = np.bincount(doc, counts > 0, len(n)).astype(np.int64)
        return pa.table({"id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(n), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES, prior: float = PRIOR, bits: int = BITS) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the whole texts of rows that are not held out. Null and empty texts are one end token. Repeated rows
    and null ids are rows like others, learned from as often as they occur and scored alike. Without any training row
    every count is 0. Every word and pair counts, those seen once as well. Extra columns are not read. A filter of more
    than ``filter_bytes`` isn't broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text_col).alias("text"))
    nbytes, trained = rows.where("not held").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-nbytes // RANGE_BYTES))
    chunks = written(rows.mapInArrow(_chunks, CHUNKS))
    counted = written(chunks.mapInArrow(_gather(parts), PACKED).groupBy("part").applyInArrow(_reduce(bits), COUNTED))
    total, distinct, size = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "distinct", "size"))).first()
    shared = None
    if size <= filter_bytes:
        held = [np.zeros(0, np.uint8)] * parts
        for r in counted.select("part", "segment").toLocalIterator():
            held[r["part"]] = np.frombuffer(bytes(r["segment"]), np.uint8)
        shared = spark.sparkContext.broadcast(held)
    asked = chunks.mapInArrow(_ask(parts, shared is None), ASKED)
    answers = written(asked.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(_answer, ANSWERED))
    remove(counted)
    segments = None if shared is None else lambda: shared.value
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(total, distinct, trained, prior, segments), SCORED)
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
