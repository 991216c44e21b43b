"""Suffix-array dedup (4): bytes covered by strings of 400 bytes that start anywhere else.

Each window of 400 bytes names one anchor in it (the 100-byte gram of least hash), so equal windows name equal grams
at the same place, and about one position in 150 is an anchor. Only suffixes at anchors whose gram recurs are
kept. Runs of windows with one anchor that recur as a whole are settled by a count. The rest enter an enhanced
suffix array: sorted by what follows the anchor, scanned with a stack into intervals of common prefixes; within an
interval, the longest common left extensions show which members repeat and whether the repeat is left-maximal. What a
suffix loses needs only its farthest extensions, so nested intervals hand on one order of lefts and leave no rows.
Intervals of too many members for one task are settled by counting their windows instead, which has no groups.

The same is done over words, as eight-byte hashes, to tell passages of over 50 words, which may be under 400 bytes.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliary.llm import textops
from foliary.llm.common import remove, table, written

#: Bytes of a repeat, windows of a slice, members of an anchor's interval tree in one task.
LENGTH, SLICE, MEMBERS = 400, 1 << 18, 5000
#: Words of a passage, bytes of a word's hash.
PASSAGE, WORD = 51, 8
RUNS = "gram long, span long, rid long, firsts array<long>, more int, lead int"
ENTRY = "gram long, single boolean, rid long, at long, left binary, right binary"
WINDOW = "gram long, key long, single boolean, rid long, a long"


def _rid() -> F.Column:
    return F.xxhash64("id", "text")


def _docs(docs: DataFrame, id_col: str, text_col: str, *carried: F.Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried).withColumn("rid", _rid())


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, rolling: textops.Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """Per slice: gram hash, span hash, first and last window and anchor of each run of windows, as positions in ``data``."""
    gram = length // 4
    width = length - gram + 1
    end = np.repeat(offsets[1:], np.diff(offsets))
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + length - 1]
        windows = len(part) - length + 1
        if windows <= 0:
            break
        prefix = rolling.prefix(part)
        grams = rolling.grams(prefix, gram)
        key = (grams & np.uint64(0xFFFFFFFFFFE00000)) | np.arange(len(grams), dtype=np.uint64)
        padded = np.concatenate([key, np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        before = np.minimum.accumulate(padded, 1).ravel()
        after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
        anchor = (least & np.uint64(0x1FFFFF)).astype(np.int64)
        valid = end[at : at + windows] - np.arange(at, at + windows) >= length
        new = np.ones(windows, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], windows) - 1
        keep = valid[first]
        first, last = first[keep], last[keep]
        a = anchor[first]
        span = textops.mix(rolling.spans(prefix, first, last + length) + (a - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        yield grams[a], span, first + at, last + at, a + at


def _symbols(column: pa.Array, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, or with ``unit`` WORD their words' hashes, end to end, and the texts' offsets in them."""
    return textops.word_hashes(column, lower=False) if unit == WORD else textops.utf8(column)


def _runs(length: int, unit: int = 1):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = textops.Rolling(SLICE + length)
        for batch in textops.batches(source, most=1 << 20):
            data, offsets = _symbols(batch.column(1), unit)
            for gram, span, first, last, a in anchors(data, offsets, length, rolling):
                doc = np.searchsorted(offsets, first, "right") - 1
                # Text with a period names one run again and again: one row with all their places.
                order = np.lexsort((first, span, gram, doc))
                doc, gram, span, first, last, a = (x[order] for x in (doc, gram, span, first, last, a))
                new = np.ones(len(order), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])
                one = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(one, len(order)).astype(np.int32)), pa.array(first - offsets[doc]))
                yield pa.record_batch(
                    [pa.array(textops.signed(gram[one])), pa.array(textops.signed(span[one])), batch.column(0).take(pa.array(doc[one])), places, pa.array((last - first)[one].astype(np.int32)), pa.array((a - first)[one].astype(np.int32))],
                    names=["gram", "span", "rid", "firsts", "more", "lead"],
                )

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) >> 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(rights: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each interval of two or more sorted suffixes that share ``depth`` bytes, inner ones first."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(rights) + 1):
        depth = common(rights[i - 1], rights[i]) if i < len(rights) else -1
        left = i - 1
        while stack and stack[-1][0] > depth:
            deep, left = stack.pop()
            yield deep, left, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, dict[int, int], bool]]:
    """Of suffixes sorted by ``rights``, with ``lefts`` what precedes each, nearest byte first.

    Per interval: its depth, the left extension that each member shares with another member where both together
    reach ``length``, and whether the interval is left-diverse (a maximal repeat with all its occurrences).
    """
    most = max(map(len, lefts), default=0)
    for depth, a, b in intervals(rights):
        if depth + most < length:
            continue
        order = sorted(range(a, b + 1), key=lefts.__getitem__)
        near = [common(lefts[x], lefts[y]) for x, y in zip(order, order[1:], strict=False)]
        found = {}
        for k, x in enumerate(order):
            left = max(near[k - 1] if k else -1, near[k] if k < len(near) else -1)
            if left + depth >= length:
                found[x] = left
        if found:
            yield depth, found, lefts[order[0]][:1] != lefts[order[-1]][:1]


def maximal_groups(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, depth, members) of each repeat of ``length`` bytes or more that grows with none of its members lost.

    Of the intervals of common prefixes of ``rights`` (sorted), those of the reversed ``lefts`` within each: a group's
    members differ in what precedes their common left, and in what follows their common depth.
    """
    most = max(map(len, lefts), default=0)
    for depth, a, b in intervals(rights):
        if depth + most < length:
            continue
        order = sorted(range(a, b + 1), key=lefts.__getitem__)
        for left, x, y in intervals([lefts[k] for k in order]):
            members = sorted(order[x : y + 1])
            if left + depth >= length and common(rights[members[0]], rights[members[-1]]) == depth:
                yield left, depth, members


def _groups(length: int):
    """The maximal groups of each anchor, one row for each member kind; rows come sorted by (gram, right)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_gram(source):
            # A kind that recurs as a whole stands for two members at least.
            twice = [r for r in rows for _ in range(1 if r[1] else 2)]
            out = []
            for left, depth, members in maximal_groups([r[4] for r in twice], [r[5] for r in twice], length):
                first = twice[members[0]]
                out += [(first[0], first[2], first[3] - left, left + depth, r[2], r[3] - left) for r in dict.fromkeys(twice[k] for k in members)]
            columns = zip(*out, strict=True) if out else ((),) * 6
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["gram", "head_rid", "head_at", "length", "rid", "at"])

    return run


def _entries(unit: int = 1):
    """The symbols around each unsettled anchor of a document: (gram, left, right) with left reversed."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.batches(source, most=1 << 20):
            data, offsets = _symbols(batch.column(1), unit)
            runs = batch.column(2)
            for k in range(batch.num_rows):
                raw = data[offsets[k] : offsets[k + 1]]
                rows = runs[k].as_py()
                out = {n: [] for n in ("gram", "single", "rid", "at", "left", "right")}
                for r in rows:
                    at = r["first"] + r["lead"]
                    out["gram"].append(r["gram"])
                    out["single"].append(r["n"] == 1)
                    out["rid"].append(batch.column(0)[k].as_py())
                    out["at"].append(at)
                    out["left"].append(raw[r["first"] : at][::-1].tobytes())
                    out["right"].append(raw[at : r["first"] + r["more"] + r["length"]].tobytes())
                yield pa.record_batch([pa.array(out["gram"], pa.int64()), pa.array(out["single"], pa.bool_()), pa.array(out["rid"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["left"], pa.binary()), pa.array(out["right"], pa.binary())], names=list(out))

    return run


def _by_gram(source: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held, key = [], None
    for batch in source:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and held:
                yield held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield held


def reach(lefts: list[bytes], rights: list[bytes], length: int, unit: int = 1) -> dict[int, tuple[int, int]]:
    """How far left and right of its anchor the repeats of each suffix go, for those with one: what ``maximal_repeats``
    finds, without a row for each of nested intervals. All repeats of a suffix hold its anchor, so they cover one span.
    ``length`` and the reach are in symbols of ``unit`` bytes, of which only whole ones count as common.

    The smaller intervals' members are put into the largest one's order of lefts, so a suffix is put in as often as the
    logarithm of their number, and a pair is compared when it becomes neighbours; copies with an edit each nest as deep
    as they are many, and sorting every interval anew would be quadratic.
    """
    most = max(map(len, lefts), default=0) // unit
    orders: dict[int, tuple[int, list[tuple[bytes, int]]]] = {}  # by first member: last member, members by left
    found: dict[int, tuple[int, int]] = {}
    for shared, a, b in intervals(rights):
        depth = shared // unit
        if depth + most < length:
            continue
        parts, at = [], a
        while at <= b:
            last, order = orders.pop(at, None) or (at, [(lefts[at], at)])
            parts.append(order)
            at = last + 1
        parts.sort(key=len)
        order = parts.pop()
        for entry in (x for part in parts for x in part):
            k = bisect.bisect(order, entry)
            for other in order[max(0, k - 1) : k + 1]:
                left = common(entry[0], other[0]) // unit
                if left + depth >= length:
                    for x in (entry[1], other[1]):
                        held = found.get(x, (0, 0))
                        found[x] = (max(held[0], left), max(held[1], depth))
            order.insert(k, entry)
        orders[a] = (b, order)
    return found


def _scan(length: int, unit: int = 1):
    """The stack scan of each anchor's suffixes; rows come sorted by (gram, right), so a partition is one suffix array."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for rows in _by_gram(source):
            for k, (left, depth) in reach([r[4] for r in rows], [r[5] for r in rows], length, unit).items():
                if rows[k][1]:
                    out.append((rows[k][2], rows[k][3] - left, rows[k][3] + depth))
            if len(out) > 5000:
                yield _spans(out)
                out = []
        yield _spans(out)

    return run


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["rid", "a", "b"])


def _windows(length: int, unit: int = 1):
    """Every window of an anchor's run with a hash, for grams with too many members for one task."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for gram, single, rid, at, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lead = len(left) // unit
                raw = np.frombuffer(left, f"V{unit}")[::-1].tobytes() + right
                n = len(raw) // unit - length + 1
                keys = [int.from_bytes(hashlib.blake2b(raw[i * unit : (i + length) * unit], digest_size=8, key=b"%d" % (lead - i)).digest(), "little", signed=True) for i in range(n)]
                start = at - lead
                yield pa.record_batch([pa.array([gram] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array([single] * n, pa.bool_()), pa.array([rid] * n, pa.int64()), pa.array(range(start, start + n), pa.int64())], names=["gram", "key", "single", "rid", "a"])

    return run


def repeated_spans(rows: DataFrame, length: int = LENGTH, members: int = MEMBERS, unit: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """(rid, spans): of each row of (rid, text) with repeats, spans whose union is what repeats of ``length`` symbols cover,
    unsorted. Symbols are bytes, with ``unit`` WORD words. Beside it the written tables that it reads."""
    every = written(rows.select("rid", "text").mapInArrow(_runs(length, unit), RUNS))
    # Most grams occur once in all texts; the runs of all others go on.
    again = every.groupBy("gram").agg(F.sum(F.size("firsts")).alias("n")).where("n > 1").select("gram")
    runs = written(every.join(again, "gram", "left_semi"))
    remove(every)
    kinds = runs.groupBy("gram", "span").agg(F.sum(F.size("firsts")).alias("n"), F.min(F.struct("rid", F.element_at("firsts", 1).alias("first"), "more", "lead")).alias("one"))
    per = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"))
    whole = runs.join(kinds.where("n > 1").select("gram", "span"), ["gram", "span"]).select("rid", F.transform("firsts", lambda x: F.struct(x.alias("a"), (x + F.col("more") + length).alias("b"))).alias("spans"))
    unsettled = written(kinds.join(per.where("kinds > 1 and fewest = 1").select("gram", "kinds"), "gram").select("gram", "n", "kinds", "one.*"))
    per_row = unsettled.groupBy("rid").agg(F.collect_list(F.struct("gram", "n", "first", "more", "lead", F.lit(length).alias("length"))).alias("runs"))
    texts = rows.select("rid", "text").join(per_row, "rid").select("rid", "text", "runs")
    # A repeated row (same id and text) brings its entries once more; as one entry they are as many as they were. A run
    # that a slice's border cuts is two entries with one anchor, told apart by their first windows.
    found = texts.mapInArrow(_entries(unit), ENTRY).withColumn("first", F.col("at") - F.expr(f"octet_length(left) div {unit}"))
    entries = written(found.dropDuplicates(["gram", "rid", "at", "first"]).drop("first"))
    large = unsettled.where(f"kinds > {members}").select("gram").distinct()
    small = entries.join(large, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "right")
    scanned = small.mapInArrow(_scan(length, unit), "rid long, a long, b long")
    windows = entries.join(large, "gram", "left_semi").mapInArrow(_windows(length, unit), WINDOW)
    often = windows.groupBy("gram", "key").agg(F.count("*").alias("n")).where("n > 1").select("gram", "key")
    counted = windows.where("single").join(often, ["gram", "key"]).select("rid", "a", (F.col("a") + length).alias("b"))
    single = scanned.unionByName(counted).select("rid", F.array(F.struct("a", "b")).alias("spans"))
    return whole.unionByName(single).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), [runs, unsettled, entries]


def merged(spans: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted((x["a"], x["b"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return out


def _covered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        counts = [sum(b - a for a, b in merged(spans)) for spans in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], names=["rid", "n_passage_words"])


def repeated_words(rows: DataFrame, words: int = PASSAGE, members: int = MEMBERS) -> DataFrame:
    """(rid, n_passage_words): of each row of (rid, text) with any, the words that strings of ``words`` words cover which also
    start anywhere else. Words are `[^\\x20\\x09-\\x0D]+` as they are written; what stands between them may differ."""
    spans, tables = repeated_spans(rows, words, members, WORD)
    found = written(spans.mapInArrow(_covered, "rid long, n_passage_words long"))
    for t in tables:
        remove(t)
    return found


def _cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textops.batches(source):
        out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode()
            gone = merged(spans)
            keep, whole, at = [], [], 0
            for a, b in gone:
                keep.append(raw[at:a])
                # The text that goes on keeps a character of which only some bytes are covered.
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                end = b
                while end > a and end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                whole.append((a, end))
                at = b
            keep.append(raw[at:])
            left, at = [], 0
            for a, b in whole:
                left.append(raw[at:a])
                at = max(a, b)
            left.append(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(b - a for a, b in gone))
            out["n_spans"].append(len(gone))
            out["kept_sha256"].append(hashlib.sha256(b"".join(keep)).hexdigest())
            out["kept"].append(b"".join(left).decode())
        carried = dict(zip(batch.schema.names[3:], batch.columns[3:], strict=True))
        yield pa.record_batch([batch.column(0), *(pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.string()), *carried.values()], names=["id", *out, *carried])


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, members: int = MEMBERS, carry: F.Column | None = None, passage: int | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept, and carried: what ``carry`` is in that row.
    With ``passage`` also n_passage_words: its words in passages of so many words that repeat; these alone remove nothing.

    Removes every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or
    another; strings are judged on the input. ``kept`` is the text that remains, in which a character goes only if
    all its bytes are covered; kept_sha256 is of the remaining bytes exactly. Null and empty texts keep nothing and
    lose nothing; repeated rows are documents of their own, so they cover each other. Extra columns are not read.
    """
    carried = [] if carry is None else ["carried"]
    rows = _docs(docs, id_col, text_col, *[carry.alias(c) for c in carried])
    # Words first: their tables are gone before those of bytes are written.
    passages = None if passage is None else repeated_words(rows, passage, members)
    spans, _ = repeated_spans(rows, length, members)
    form = StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    for c in carried:
        form = form.add(c, rows.schema[c].dataType)
    found = rows.join(spans, "rid", "left")
    if passages is not None:
        found = found.join(passages, "rid", "left").withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0)))
        carried, form = [*carried, "n_passage_words"], form.add("n_passage_words", "long")
    return found.select("id", "text", "spans", *carried).mapInArrow(_cut, form)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, members: int = MEMBERS) -> DataFrame:
    """(head, length, id, at): maximal repeats of ``length`` bytes or more with all their occurrences, by byte places.

    A group is named by its head, the row hash and place of one occurrence, and its length; ``at`` is where an occurrence
    starts in the text of ``id``. What is told apart is the bytes around one anchor, so a repeat that is longer than an
    anchor's run is several groups, one for each of its anchors. An anchor of more than ``members`` kinds gives groups of
    exactly ``length`` bytes instead, by counting. Null and empty texts have none; repeated rows share their occurrences.
    """
    rows = _docs(docs, id_col, text_col)
    every = rows.select("rid", "text").mapInArrow(_runs(length), RUNS)
    kinds = written(every.groupBy("gram", "span").agg(F.collect_list(F.struct("rid", "firsts")).alias("places"), F.sum(F.size("firsts")).alias("n"), F.min(F.struct("rid", F.element_at("firsts", 1).alias("first"), "more", "lead")).alias("one")))
    again = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    mine = kinds.join(again, "gram").select("gram", "n", "kinds", "one.*")
    per_row = mine.groupBy("rid").agg(F.collect_list(F.struct("gram", "n", "first", "more", "lead", F.lit(length).alias("length"))).alias("runs"))
    texts = rows.select("rid", "text").dropDuplicates(["rid"]).join(per_row, "rid").select("rid", "text", "runs")
    entries = written(texts.mapInArrow(_entries(), ENTRY))
    large = again.where(f"kinds > {members}").select("gram")
    small = entries.join(large, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "right")
    found = small.mapInArrow(_groups(length), "gram long, head_rid long, head_at long, length long, rid long, at long")
    windows = entries.join(large, "gram", "left_semi").mapInArrow(_windows(length), WINDOW)
    several = windows.groupBy("gram", "key").agg(F.min(F.struct("rid", "a")).alias("head"), F.collect_list(F.struct("rid", "a")).alias("all"), F.bool_or(~F.col("single")).alias("again")).where("again or size(all) > 1")
    counted = several.select("gram", F.col("head.rid").alias("head_rid"), F.col("head.a").alias("head_at"), F.lit(length).cast("long").alias("length"), F.explode("all").alias("x")).select("gram", "head_rid", "head_at", "length", F.col("x.rid").alias("rid"), F.col("x.a").alias("at"))
    kind = kinds.select("gram", F.col("one.rid").alias("rid"), F.col("one.first").alias("first"), F.col("one.more").alias("more"), "places")
    parts = found.unionByName(counted).join(kind, ["gram", "rid"]).where(f"at >= first and at + length <= first + more + {length}")
    parts = parts.select(F.struct(F.col("head_rid").alias("rid"), F.col("head_at").alias("at")).alias("head"), "length", (F.col("at") - F.col("first")).alias("shift"), F.inline("places"))
    places = parts.select("head", "length", "rid", "shift", F.explode("firsts").alias("first")).select("head", "length", "rid", (F.col("first") + F.col("shift")).alias("at")).distinct()
    return places.join(rows.select("rid", "id"), "rid").select("head", "length", "id", "at")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array_dedup(table(spark, sf_dir, "documents"), passage=PASSAGE)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"), "n_passage_words")
