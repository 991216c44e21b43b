"""Chapter trees against a walk with a stack, and over a document of very many headings."""

import random
import time

from pyspark.sql import functions as F

from foliary.operators import chapters, sections


def walked(rows):
    """(order: id, path, depth, parent, end page) of one document's headings (order, page, level, title)."""
    stack, out, count = [], {}, {}
    last = max(r[1] for r in rows)
    for k, (order, page, level, title) in enumerate(rows):
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1] if stack else None
        key = parent[1] if parent else None
        count[key] = count.get(key, 0) + 1
        number = f"{parent[2]}.{count[key]}" if parent else f"ch{count[key]}"
        path = f"{parent[3]}/{title}" if parent else title
        later = next((r[1] for r in rows[k + 1 :] if r[2] <= level), None)
        out[order] = (number, path, len(stack), key, max(page, later - 1) if later is not None else last)
        stack.append((level, order, number, path))
    return out


def test_numbers_paths_and_pages_are_those_of_a_walk(spark):
    rng = random.Random(7)
    docs = {d: [(k * 2, k // 5, rng.randrange(1, 6), f"t{rng.randrange(30)}") for k in range(rng.choice([1, 2, 40, 90]))] for d in range(12)}
    docs[99] = [(0, 0, 4, "deep"), (1, 0, 2, "b"), (2, 0, 4, "c"), (3, 0, 3, "d"), (4, 0, 1, "e"), (5, 0, 1, "f")]
    rows = spark.createDataFrame([(d, *r) for d, v in docs.items() for r in v], "doc_id long, block_idx int, page_idx int, level int, title string").repartition(5)
    got = {}
    for r in chapters.numbered(rows).collect():
        got.setdefault(r["doc_id"], {})[r["block_idx"]] = (r["chapter_id"], r["path"], r["depth"], r["parent"], r["end_page"])
    assert got == {d: walked(v) for d, v in docs.items()}
    above = {(r["doc_id"], r["block_idx"]): len(r["ancestors"]) for r in chapters.with_ancestors(rows).collect()}
    assert above == {(d, k): v[2] for d, x in got.items() for k, v in x.items()}
    assert chapters.numbered(rows.limit(0)).collect() == []


def test_time_is_linear_in_a_documents_headings(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("block_idx"), (F.col("id") / 20).cast("int").alias("page_idx"), (1 + F.pmod(F.xxhash64("id"), F.lit(5))).cast("int").alias("level"), F.col("id").cast("string").alias("title"))
    began = time.time()
    assert chapters.numbered(rows).agg(F.max("depth")).first()[0] == 4
    assert sections.subtree_spans(rows.withColumn("last_idx", F.lit(99_999)), "doc_id").agg(F.max("stop")).first()[0] == 100_000
    assert time.time() - began < 60  # quadratic frames took that long for 16,000
