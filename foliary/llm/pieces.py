"""SentencePiece encoding and decoding (1): giant documents by a max-plus parallel scan over chunks.

The model file is a BPE model: its encoding is what merging neighbours by score leaves. A sequence of pieces is that
encoding just when the merges leave each two neighbours of it apart, so encoding is a path over states (the piece that
reaches a place), and a step scores 0 if its two pieces stay apart, else minus infinity. A giant document is split
into chunks. A chunk's transfer matrix holds the best score from each piece that may reach over its start to each that
may reach over its end. Max-plus products of matrices are associative: they combine a segment's chunks, then a
document's segments; the prefix and suffix scores that come back down name the piece at each border, and each chunk is
traced by itself.

No piece of such a model has a space mark after another character, so every space mark that follows one is a cut that
all paths pass: what lies between a chunk's first and last cut is the same for all its states, and words there encode
alike wherever they stand, so the library encodes each distinct word once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import textops
from foliary.llm.common import table, written
from foliary.llm.wordcache import WordCache

MARK = "▁"
#: Characters of a chunk (longer texts are giant), chunks of a segment, words and pairs of pieces of a task's caches.
CHUNK, SEGMENT, CACHE = 1 << 13, 32, 400_000
NONE = np.float32(-np.inf)
#: A piece by where it starts and ends.
State = tuple[int, int]


class Pieces:
    """A model file's pieces with scores, and byte pieces for characters that no piece has."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model
        self.score: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        for i in range(model.vocab_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(text[3:5], 16)] = i
                self.raw.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.score[text] = (model.get_score(i), i)
                self.raw.append(text.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("pieces that reach over words are not supported")
        self.longest = max(map(len, self.score))
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: How ids travel between tasks: two bytes where the vocabulary allows.
        self.narrow = "<u2" if len(self.raw) <= 1 << 16 else "<u4"
        self.apart: dict[tuple[str, str], bool] = {}
        self.cache = WordCache(self.library, CACHE)

    def library(self, words: list[str]) -> list[list[int]]:
        """Ids of words that start with a space; the library puts one before each text itself."""
        found = self.model.encode([w[1:] for w in words], num_threads=1)
        return [x if w != " " else [self.score[MARK][1]] for w, x in zip(words, found, strict=True)]

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a short text: of all neighbours that make a piece, the best goes first, the left one of equal ones."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                hit = self.score.get(parts[k] + parts[k + 1])
                if hit is not None and hit[0] > best:
                    best, at = hit[0], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, left: str, right: str) -> bool:
        """Whether merging leaves two neighbours, or one piece after nothing, as they are."""
        key = (left, right)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > CACHE:
                self.apart.clear()
            found = self.apart[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def ends(self, text: str, a: int) -> Iterator[int]:
        """Where a piece that starts at ``a`` may end. A character that no piece has is one of its own."""
        yield a + 1
        for b in range(a + 2, min(a + self.longest, len(text)) + 1):
            if text[a:b] in self.score:
                yield b

    def states(self, text: str, border: int) -> list[State]:
        """The pieces that start before ``border`` and end there or beyond, in order; the text's start is a state of its own."""
        if border == 0:
            return [(0, 0)]
        return [(a, b) for a in range(max(0, border - self.longest), border) for b in self.ends(text, a) if b >= border and self.stays("", text[a:b])]

    def reach(self, text: str, entries: list[State], stop: int) -> dict[State, int]:
        """All states on paths from ``entries`` whose pieces start before ``stop``, each with a bit for every entry it is reached from."""
        found = {s: 1 << i for i, s in enumerate(entries)}
        ending: dict[int, list[State]] = {}
        for s in entries:
            ending.setdefault(s[1], []).append(s)
        for at in range(min(ending), stop):
            for a, b in ending.pop(at, ()):
                mask, piece = found[a, b], text[a:b]
                for to in self.ends(text, at):
                    if self.stays(piece, text[at:to]):
                        if (at, to) not in found:
                            found[at, to] = 0
                            ending.setdefault(to, []).append((at, to))
                        found[at, to] |= mask
        return found

    def cut(self, text: str, places: range) -> int:
        """The first of the places that all paths pass, or -1."""
        for k in places:
            if text[k] == MARK and (k == 0 or text[k - 1] != MARK):
                return k
        return -1

    def transfer(self, text: str, a: int, b: int) -> np.ndarray:
        """The transfer matrix of the chunk from ``a`` to ``b``, with ``longest`` characters of the text at either side."""
        entries, exits = self.states(text, a), self.states(text, b)
        first = self.cut(text, range(a, b))
        if first < 0:
            found = self.reach(text, entries, b)
            return np.array([[0.0 if found.get(s, 0) >> i & 1 else NONE for s in exits] for i in range(len(entries))], np.float32)
        last = self.cut(text, range(b - 1, first - 1, -1))
        # Entries that end at the first cut are whole; exits are what a fresh start at the last cut reaches.
        whole = 0
        for (_, e), mask in self.reach(text[:first], entries, first).items():
            whole |= mask if e == first else 0
        head = np.array([0.0 if whole >> i & 1 else NONE for i in range(len(entries))], np.float32)
        found = self.reach(text, [(last, last)], b)
        return head[:, None] + np.array([0.0 if s in found else NONE for s in exits], np.float32)[None, :]

    def trace(self, text: str, entry: State, leave: State, stop: int) -> list[int]:
        """Ids of the pieces after ``entry`` up to and with ``leave``."""
        found = self.reach(text, [entry], stop)
        before: dict[int, list[int]] = {}
        for a, b in found:
            before.setdefault(b, []).append(a)
        out: list[int] = []
        while leave != entry:
            out += self.ids(text[leave[0] : leave[1]])[::-1]
            leave = next((a, leave[0]) for a in before[leave[0]] if self.stays(text[a : leave[0]], text[leave[0] : leave[1]]))
        return out[::-1]

    def ids(self, piece: str) -> list[int]:
        hit = self.score.get(piece)
        return [hit[1]] if hit else [self.bytes[x] for x in piece.encode()]

    def between(self, text: str, a: int, b: int, i: int, j: int) -> tuple[list[int], str, list[int]]:
        """Ids of the pieces that start in the chunk before its first cut, what lies between its cuts, and ids after the last."""
        entry, leave = self.states(text, a)[i], self.states(text, b)[j]
        first = self.cut(text, range(a, b))
        if first < 0:
            return self.trace(text, entry, leave, b), "", []
        last = self.cut(text, range(b - 1, first - 1, -1))
        head = text[:first]
        closing = next((s for s in self.reach(head, [entry], first) if s[1] == first), entry)
        return self.trace(head, entry, closing, first), text[first:last], self.trace(text, (last, last), leave, b)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts end to end, and how many each has. A space stands before each text that isn't empty."""
        # The mark itself in a text is a space too; it's rare, so it is replaced only where it occurs.
        texts = [" " + (t.replace(MARK, " ") if MARK in t else t) if t else "" for t in column.to_pylist()]
        return self.by_word(texts)

    def by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are empty or start with a space, end to end, and how many each has; cuts part their words."""
        data, at = textops.utf8(pa.array(texts, pa.string()))
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ids, sizes = self.cache.ids(data, starts, np.append(starts[1:], len(data)))
        return ids, np.bincount(np.searchsorted(at, starts, "right") - 1, sizes, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 of each text from its ids: the pieces' bytes end to end, without the space that stands before it."""
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        raw = memoryview(self.flat[at].tobytes())
        ends = np.cumsum(np.concatenate([[0], sizes]))[np.concatenate([[0], np.cumsum(counts)])]
        return [bytes(raw[a + 1 : b]) if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


OUT = "id long, chunks long, n_tokens long, ids binary"


def _blobs(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(np.concatenate([[0], counts]))
    return pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def _short(path: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.batches(source, most=1 << 21):
            ids, counts = pieces(path).encode(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(np.ones(len(counts), np.int64)), pa.array(counts), _blobs(ids, counts)], names=["id", "chunks", "n_tokens", "ids"])

    return run


def _transfers(path: str):
    """The matrix of each chunk of (row, k, a, b, text)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in source:
            rows = batch.to_pylist()
            found = [p.transfer(r["text"], r["a"], r["b"]) for r in rows]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], names=["row", "k", "wide", "matrix"])

    return run


def _traced(path: str):
    """The narrow ids of each chunk of (row, k, a, b, text, i, j): heads and tails by path, what lies between by word, a batch at once."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in textops.batches(source, most=1 << 21):
            parts = [p.between(r["text"], r["a"], r["b"], r["i"], r["j"]) for r in batch.to_pylist()]
            ids, counts = p.by_word([x[1].replace(MARK, " ") for x in parts])
            ends = np.cumsum(counts)
            found = [np.concatenate([np.array(h, np.uint32), ids[e - n : e], np.array(t, np.uint32)]).astype(p.narrow).tobytes() for (h, _, t), e, n in zip(parts, ends, counts, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["row", "k", "ids"])

    return run


def _cut(chunk: int, longest: int):
    """Rows of (id, row, text) in chunks k with what reaches over their borders on both sides; a to b is the chunk itself.
    One pass over a text's bytes, which finds where the chunks' characters start."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for own, row, value in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = np.frombuffer(value.as_buffer(), np.uint8)
                starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                n = len(starts) - 1
                for k in range(-(-n // chunk)):
                    left, right = max(0, k * chunk - longest), min(n, (k + 1) * chunk + longest)
                    a = k * chunk - left
                    text = raw[starts[left] : starts[right]].tobytes().decode()
                    yield pa.record_batch([pa.array([own.as_py()], pa.int64()), pa.array([row.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([a], pa.int32()), pa.array([a + min(chunk, n - k * chunk)], pa.int32()), pa.array([text])], names=["id", "row", "k", "a", "b", "text"])

    return run


def _widened(path: str):
    """Rows of (id, chunks, the chunks' ids) with all ids in four bytes, each text's in one pass."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k in range(batch.num_rows):
                ids = np.frombuffer(b"".join(batch.column(2)[k].as_py()), pieces(path).narrow)
                yield pa.record_batch([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["id", "chunks", "n_tokens", "ids"])

    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices; it is associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def _matrices(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m, np.float32).reshape(w, -1) for w, m in zip(rows["wide"], rows["matrix"], strict=True)]


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    """The product of a segment's matrices."""
    rows = rows.sort_values("k")
    first, *rest = _matrices(rows)
    for m in rest:
        first = product(first, m)
    return pd.DataFrame({"row": rows["row"].iloc[:1], "segment": rows["segment"].iloc[:1], "wide": len(first), "matrix": [first.tobytes()]})


def scan(parts: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The best scores of all states at each border: of paths from ``before`` to it, and of paths from it to ``after``."""
    prefix, suffix = [before], [after]
    for m in parts:
        prefix.append((prefix[-1][:, None] + m).max(0))
    for m in reversed(parts):
        suffix.append((m + suffix[-1][None, :]).max(1))
    return prefix, suffix[::-1]


def _segments(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one document: what its other segments give each segment, before it and after it."""
    rows = rows.sort_values("segment")
    parts = _matrices(rows)
    prefix, suffix = scan(parts, np.zeros(len(parts[0]), np.float32), np.zeros(parts[-1].shape[1], np.float32))
    return pd.DataFrame({"row": rows["row"], "segment": rows["segment"], "before": [x.tobytes() for x in prefix[:-1]], "after": [x.tobytes() for x in suffix[1:]]})


def _borders(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one segment: the states in which each chunk is entered and left, those whose paths score best on both sides."""
    rows = rows.sort_values("k")
    before, after = (np.frombuffer(rows[c].iloc[0], np.float32) for c in ("before", "after"))
    prefix, suffix = scan(_matrices(rows), before, after)
    best = [int((p + s).argmax()) for p, s in zip(prefix, suffix, strict=True)]
    return pd.DataFrame({"row": rows["row"], "k": rows["k"], "i": best[:-1], "j": best[1:]})


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """One row per input row: id, chunks, n_tokens, ids (little-endian 32-bit), as the library encodes each text.

    Texts of more than ``chunk`` characters go through the scan. Null and empty texts have no ids. Repeated rows and
    null ids are rows like others; extra columns are not read. A task holds a segment's matrices, a few KB each, or a
    document's segments, of which there are at most 8,192 in the 2 GB that Spark allows a text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    giant = F.length("text") > chunk
    short = rows.where(~giant).mapInArrow(_short(path), OUT)
    longest = pieces(path).longest
    if chunk < longest:
        raise ValueError(f"a chunk holds at least {longest} characters")
    whole = F.concat(F.lit(MARK), F.translate("text", " ", MARK))
    # Written, so a chunk's row number is the same for every step.
    large = rows.where(giant).select("id", F.monotonically_increasing_id().alias("row"), whole.alias("text"))
    chunks = written(large.mapInArrow(_cut(chunk, longest), "id long, row long, k int, a int, b int, text string"))
    # Matrices are small but take time, so they are dealt by number: by their bytes alone they would meet in one task.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matrices = written(chunks.select("row", "k", "a", "b", "text").mapInArrow(_transfers(path), "row long, k int, wide int, matrix binary").withColumn("segment", F.expr(f"cast(k div {segment} as int)")))
    dealt = matrices.repartition(tasks, "row", "segment")
    combined = dealt.groupBy("row", "segment").applyInPandas(_combined, "row long, segment int, wide int, matrix binary")
    around = combined.repartition(tasks, "row").groupBy("row").applyInPandas(_segments, "row long, segment int, before binary, after binary")
    borders = dealt.join(around, ["row", "segment"]).groupBy("row", "segment").applyInPandas(_borders, "row long, k int, i int, j int")
    traced = chunks.join(borders, ["row", "k"]).select("row", "k", "a", "b", "text", "i", "j").mapInArrow(_traced(path), "row long, k int, ids binary")
    ids = traced.groupBy("row").agg(F.count("*").alias("chunks"), F.expr("transform(array_sort(collect_list(struct(k, ids))), x -> x.ids)").alias("parts"))
    named = ids.join(chunks.where("k = 0").select("row", "id"), "row")
    return short.unionByName(named.select("id", "chunks", "parts").mapInArrow(_widened(path), OUT))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(id, chunks, n_tokens, ids_crc32, text) of rows with ids."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in textops.batches(source, "ids", 1 << 22):
            raw = batch.column(3).to_pylist()
            ids = np.frombuffer(b"".join(raw), "<u4")
            texts = p.decode(ids, batch.column(2).to_numpy())
            yield pa.record_batch([*batch.columns[:3], pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "chunks", "n_tokens", "ids_crc32", "text"])

    return encoded.mapInArrow(run, "id long, chunks long, n_tokens long, ids_crc32 long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents: the ids' digest and the decoded text's, beside the text's own size."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
    return found.select(F.col("id").alias("doc_id"), "chunks", "n_tokens", "ids_crc32", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
