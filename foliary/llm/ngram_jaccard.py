"""N-gram Jaccard join (9): prefix filters under two global token orders, intersected before verification.

A document's set is its distinct word shingles; equal sets are one node with members. A set can only have a partner
if most of its shingles occur in another set too, which one pass over all shingles finds; for the sets that stay,
every shared shingle's frequency is counted and two orders, both rarest first, rank each set's shingles. Linked sets
share a shingle among the first few under either order, so they lie in one connected part of either order's prefix
graph (linear in its size: each prefix shingle ties its sets to the smallest of them). Only sets together in both
parts are verified, exactly and in blocks (first with one block of their part, then what that leaves unlinked with the
rest), and the verified links give the components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm import textops
from foliary.llm.common import components, remove, table, written

#: Shingles gathered before a task hands them on, bytes of text for each range of shingles, sets of a verified block, bytes of a batch.
FLUSH, RANGE_BYTES, BLOCK, BATCH = 300_000, 1 << 23, 256, 1 << 20
#: Stands for no owner; row numbers are 0 or more.
NOBODY = -1
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SCATTER = "part int, rid long, size int, node binary, here int, rids binary, counts binary, grams binary"
SCHEMA = pa.schema([("part", pa.int32()), ("rid", pa.int64()), ("size", pa.int32()), ("node", pa.binary()), ("here", pa.int32()), ("rids", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])


def _scatter(shingle: int, parts: int):
    """Each document's row (rid, size, node, shingles already known as shared) and, by range, the shingles still in question."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}
        for k, (_, node, _) in enumerate(held):
            first.setdefault(node, k)
        own = [held[k] for k in first.values()]
        sizes = np.array([len(x[2]) for x in own], np.int64)
        grams = np.concatenate([x[2] for x in own]) if own else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(ranked)))
        shared = np.zeros(len(grams), bool)
        shared[order] = np.repeat(n > 1, n)
        here = np.bincount(owner, shared, len(own)).astype(np.int64)
        known = {x[0]: int(here[k]) for k, x in enumerate(own)}
        rows = [(hash_part(r, parts), r, len(g), node, known.get(r), None, None, None) for r, node, g in held]
        # Shared here: one entry without an owner (NOBODY) is enough for the others; else by owner.
        many = ranked[start[n > 1]]
        lone_grams, lone_owner = grams[~shared], owner[~shared]
        rid = np.array([x[0] for x in own], np.int64)
        all_grams = np.concatenate([many, lone_grams])
        all_owner = np.concatenate([np.full(len(many), -1), lone_owner])
        part = (all_grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.lexsort((all_owner, part))
        part, all_owner, all_grams = part[order], all_owner[order], all_grams[order]
        for p in np.unique(part):
            a, b = np.searchsorted(part, [p, p + np.uint64(1)])
            who, count = np.unique(all_owner[a:b], return_counts=True)
            # 32 bits are enough within a range, whose size doesn't grow: a false match only lets a set stay in question.
            low = all_grams[a:b].astype("<u4")
            ids = np.where(who < 0, NOBODY, rid[who])
            rows.append((int(p), None, None, None, None, ids.astype("<i8").tobytes(), count.astype("<u4").tobytes(), low.tobytes()))
        for a in range(0, len(rows), 2000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 2000], strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in textops.batches(source, most=BATCH):
            for rid, grams in zip(batch.column(0).to_pylist(), textops.shingle_sets(batch.column(1), shingle), strict=True):
                held.append((rid, hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else b"", grams))
                total += len(grams)
            if total >= FLUSH:
                yield from flush(held)
                held, total = [], 0
        if held:
            yield from flush(held)

    return run


def hash_part(rid: int, parts: int) -> int:
    return ((rid % (1 << 64)) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) * parts >> 32


def _match(parts: int):
    """Of one range: per document, how many of its shingles here another owner has too, packed by the documents' own part."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = rows.column("grams")
        packed = rows.filter(pc.is_valid(kinds))
        ids = np.frombuffer(b"".join(packed.column("rids").to_pylist()), "<i8")
        counts = np.frombuffer(b"".join(packed.column("counts").to_pylist()), "<u4").astype(np.int64)
        grams = np.frombuffer(b"".join(packed.column("grams").to_pylist()), "<u4")
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(ranked)))
        seen = np.empty(len(grams), bool)
        seen[order] = np.repeat(n > 1, n)
        per = np.add.reduceat(seen.astype(np.int64), np.cumsum(counts) - counts) if len(counts) else np.zeros(0, np.int64)
        some = (per > 0) & (ids != NOBODY)
        ids, per = ids[some], per[some]
        to = (ids.view(np.uint64) * SPREAD >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.argsort(to, kind="stable")
        to, ids, per = to[order], ids[order], per[order]
        out = rows.filter(pc.is_null(kinds)).to_pylist()
        for part in np.unique(to):
            a, b = np.searchsorted(to, [part, part + np.uint64(1)])
            out.append({"part": int(part), "rids": ids[a:b].astype("<i8").tobytes(), "counts": per[a:b].astype("<u4").tobytes()})
        return pa.Table.from_pylist(out, SCHEMA)

    return run


def _total(rows: pa.Table) -> pa.Table:
    """Of one part of the documents: each document's row with the sum of what every range has found."""
    packed = pc.is_valid(rows.column("rids"))
    own, more = rows.filter(pc.invert(packed)), rows.filter(packed)
    ids = np.frombuffer(b"".join(more.column("rids").to_pylist()), "<i8")
    counts = np.frombuffer(b"".join(more.column("counts").to_pylist()), "<u4")
    rid = own.column("rid").to_numpy()
    known, inverse = np.unique(rid, return_inverse=True)
    sums = np.zeros(len(known) + 1, np.int64)
    if len(known):
        np.add.at(sums, np.searchsorted(known, ids), counts)
    here = pc.fill_null(own.column("here"), -1).to_numpy()
    seen = np.where(here < 0, 0, here + sums[:-1][inverse] if len(known) else here)
    return pa.table({"rid": own.column("rid"), "size": own.column("size"), "node": own.column("node"), "seen": pa.array(seen, pa.int64())})


def _sets(shingle: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.batches(source, most=BATCH):
            sets = [x.tobytes() for x in textops.shingle_sets(batch.column(1), shingle)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "grams"])

    return run


def block_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join all sets of a block that reach each other by links inside it: at most one fewer than its sets."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets])
    grams, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    kept = df[inverse] > 1
    column = (np.cumsum(df > 1) - 1)[inverse[kept]]
    owner, width = owner[kept], int((df > 1).sum())
    both = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, width, 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        x = np.zeros((m, min(2048, width - at)), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    linked = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
    root = np.full(m, -1)
    out = []
    for seed in range(m):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        edge = [seed]
        while edge:
            at = edge.pop()
            new = np.flatnonzero(linked[at] & (root < 0))
            root[new] = seed
            out += [(at, int(k)) for k in new]
            edge += new.tolist()
    return out


def _verify(num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows["node"].tolist()
        found = block_links([np.frombuffer(x, np.uint64) for x in rows["grams"]], num, den) if len(rows) > 1 else []
        return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}, columns=["a", "b"])

    return run


def _prefixes(ranked: DataFrame, order: str, num: int, den: int) -> DataFrame:
    """Edges (a, b) between nodes that share a shingle among the first size - ceil(t * size) + 1 under an order."""
    place = F.row_number().over(Window.partitionBy("node").orderBy(*[F.expr(x) for x in order.split(" | ")]))
    first = ranked.withColumn("place", place + F.col("alone")).where(f"place <= size - ceil({num} * size / {den}) + 1").select("node", "gram")
    least = first.groupBy("gram").agg(F.min("node").alias("b"))
    return first.join(least, "gram").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _verified(jobs: DataFrame, packed: DataFrame, num: int, den: int) -> DataFrame:
    """Links within each job of jobs (node, and the columns that name a job)."""
    names = [c for c in jobs.columns if c != "node"]
    return written(jobs.join(packed, "node").groupBy(*names).applyInPandas(_verify(num, den), "a long, b long"))


def _linked(together: DataFrame, packed: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of the linked nodes of together (node, root, other, size), whose parts are (root, other).

    Blocks are by hash, about BLOCK sets each. First each block is verified with its part's block 0: two rows a set.
    What that leaves outside the part's largest component is then verified with all sets of the part whose size
    allows a link: sizes fall in bands one threshold wide, so only neighbouring bands meet.
    """
    part = ["root", "other"]
    size = together.groupBy(part).agg(F.expr(f"cast(count(*) div {BLOCK} as int)").alias("last"))
    placed = written(together.join(size, part).withColumn("job", F.expr("cast(pmod(xxhash64(node), last + 1) as int)")))
    centre = placed.where("job = 0").withColumn("job", F.explode(F.sequence(F.lit(0), "last")))
    near = _verified(placed.where("job > 0").unionByName(centre).select("node", *part, "job"), packed, num, den)
    local = written(components(near))
    named = placed.where("last > 0").join(local.withColumnRenamed("root", "near"), "node", "left").withColumn("near", F.coalesce("near", "node"))
    main = named.groupBy(*part, "near").agg(F.count("*").alias("n")).groupBy(part).agg(F.max(F.struct("n", "near")).alias("main"))
    band = F.floor(F.log("size") / F.lit(1.000001 * max(math.log(den / num), 0.01))).cast("int")
    kinds = named.join(main, part).select("node", *part, (F.col("near") != F.col("main.near")).alias("outside"), band.alias("band"))
    groups = written(kinds.groupBy(*part, "outside", "band").agg(F.expr(f"cast(count(*) div {BLOCK} as int)").alias("top")))
    outer = groups.where("outside").select(*part, F.col("band").alias("at"), F.explode(F.sequence(F.lit(0), "top")).alias("i"))
    if outer.isEmpty():
        return local
    blocks = kinds.join(groups, [*part, "outside", "band"]).select("node", *part, F.struct("outside", "band", F.expr("cast(pmod(xxhash64(node), top + 1) as int)").alias("block")).alias("key"))
    blocks = written(blocks)
    one = outer.select(*part, F.struct(F.lit(True).alias("outside"), F.col("at").alias("band"), F.col("i").alias("block")).alias("one"))
    inner = groups.select(*part, "outside", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("at"), "band", F.explode(F.sequence(F.lit(0), "top")).alias("block"))
    two = inner.select(*part, "at", F.struct("outside", "band", "block").alias("two"))
    jobs = written(one.withColumn("at", F.col("one.band")).join(two, [*part, "at"]).where("not two.outside or one <= two").select(*part, "one", "two"))
    rows = blocks.join(jobs.withColumn("key", F.col("one")), [*part, "key"]).select("node", *part, "one", "two")
    rows = rows.union(blocks.join(jobs.where("one <> two").withColumn("key", F.col("two")), [*part, "key"]).select("node", *part, "one", "two"))
    return components(near.union(_verified(rows, packed, num, den)))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 75, den: int = 100, row_col: str | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, node (its set), component (smallest id that links reach).
    Where ``row_col`` names a column, also row and kept.

    Sets link when den * intersection >= num * union; num / den must be at least 1/2. Null and empty texts and
    texts without words have no shingle, node null, and link with nothing: their component is their own id.
    Repeated rows and null ids are ordinary members of their text's node. Long texts are read whole. ``row_col`` is a long of 0 or more that is another
    in each row and the same whenever docs is read; of rows that links reach, kept is true for one with the smallest id (a null
    id is the largest), and for each row without shingles.
    """
    named = ["row"] if row_col else []
    # A row's own number names it, whatever its id and text; written, so it is the same whenever it is read.
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"), *[F.col(row_col).alias("row") for _ in named])
    keyed = source if row_col else written(source)
    nbytes = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-nbytes // RANGE_BYTES))
    tally = written(
        keyed.select("rid", "text").mapInArrow(_scatter(shingle, parts), SCATTER).groupBy("part").applyInArrow(_match(parts), SCATTER)
        .groupBy("part").applyInArrow(_total, "rid long, size int, node binary, seen long")
    )
    per = tally.groupBy("rid").agg(F.max("size").alias("size"), F.max("node").alias("node"), F.max("seen").alias("seen"))
    members = written(keyed.select("id", "rid", *named).join(per, "rid").select("id", "rid", "size", "node", "seen", *named))
    remove(tally)
    open_nodes = written(members.where("size > 0").groupBy("node", "size").agg(F.max("seen").alias("seen"), F.min("rid").alias("rid")).where(f"{den} * seen >= {num} * size"))
    # From here on a set goes by the least of its rows' hashes, eight bytes instead of sixteen.
    texts = keyed.join(open_nodes.select("rid"), "rid").select(F.col("rid").alias("node"), "text")
    packed = written(texts.mapInArrow(_sets(shingle), "node long, grams binary").dropDuplicates(["node"]))
    grams = packed.select("node", F.col("grams")).mapInArrow(_unpack, "node long, gram long")
    df = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = grams.join(df, "gram")
    whole = open_nodes.select(F.col("rid").alias("node"), "size")
    count = shared.groupBy("node").agg(F.count("*").alias("common")).join(whole, "node").where(f"{den} * common >= {num} * size")
    ranked = written(shared.join(count.withColumn("alone", F.expr("size - common")).select("node", "size", "alone"), "node"))
    first = components(_prefixes(ranked, "df | gram", num, den))
    second = components(_prefixes(ranked, "bit_length(bin(df)) | xxhash64(gram)", num, den))
    remove(ranked)
    together = written(first.join(second.withColumnRenamed("root", "other"), "node").join(whole, "node"))
    named_by = open_nodes.select("rid", "node")
    linked = _linked(together, packed, num, den).withColumnRenamed("node", "rid").join(named_by, "rid").select("node", F.col("root").alias("rid"))
    roots = linked.join(named_by.withColumnRenamed("node", "named"), "rid").select("node", F.col("named").alias("root"))
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    one = [F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("one") for _ in named]
    least = rooted.where("size > 0").groupBy("root").agg(F.min("id").alias("component"), *one)
    kept = [F.when(F.col("size") > 0, F.col("row") == F.col("one.row")).otherwise(F.lit(True)).alias("kept") for _ in named]
    return rooted.join(least, "root", "left").select(
        "id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("node")).alias("node"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component"), *named, *kept
    )


def _unpack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            sets = part.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in sets])
            yield pa.record_batch([part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), sizes))), pa.array(np.frombuffer(b"".join(sets), np.int64))], names=["node", "gram"])


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
