"""Walks over each key's rows: the same as by hand, and quick over very many keys of few rows."""

import random
import time

from pyspark.sql import functions as F

from foliary.operators import chapters, sections


def test_crosschecked_and_located_over_many_keys(spark):
    began = time.time()
    docs = spark.range(20_000).select(F.col("id").alias("source"))
    names = lambda *x: docs.select("source", F.posexplode(F.array(*[F.lit(y) for y in x])).alias("pos", "title"))
    got = sections.crosschecked(names("甲乙丙丁", "戊", "别处", "己"), names("戊", "说明甲乙丙丁", "戊", "己"))
    assert got.groupBy("toc_count", "matched").count().collect() == [(4, 3, 20_000)]
    heads = names("甲章", "甲章", "丁").select("source", "pos", F.lit(0).alias("page_idx"), F.col("title").alias("text"))
    blocks = names("丁", "甲 章", "丙", "甲章", "丁").select("source", F.col("pos").alias("block_idx"), F.lit(0).alias("page_idx"), F.col("title").alias("text"))
    found = sections.located(heads, blocks).groupBy("pos", "block_idx").count().orderBy("pos").collect()
    assert [tuple(r) for r in found] == [(0, 1, 20_000), (1, 3, 20_000), (2, 4, 20_000)]
    assert time.time() - began < 60


def test_crosschecked_sides_that_lack_rows(spark):
    toc = spark.createDataFrame([(1, 0, "甲"), (1, 1, None), (2, 0, "乙"), (None, 0, "丙")], "source long, pos int, title string")
    body = spark.createDataFrame([(1, 0, ""), (1, 1, "甲"), (3, 0, "丁"), (None, 1, "丙")], "source long, pos int, title string")
    got = sorted(map(tuple, sections.crosschecked(toc, body).collect()), key=repr)
    assert got == [(1, 2, 1), (2, 1, 0), (None, 1, 1)]
    assert sections.crosschecked(toc.limit(0), body).collect() == []


def test_running_headers_over_many_documents_and_batches(spark):
    began = time.time()
    rng = random.Random(16)
    one = [(k, k // 3, rng.choice("甲乙丙"), rng.choice([1, 1, 2, None])) for k in range(60)]
    kept, want = [], []
    for k, page, title, level in one:
        if level is None or not any(a == level and b == title and 0 <= page - c <= 3 for a, b, c in kept[-8:]):
            kept.append((level, title, page))
            want.append(k)
    rows = spark.createDataFrame(one, "block_idx int, page_idx int, title string, level int").withColumn("number", F.lit(""))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"))
    got = chapters.without_running_headers(docs.crossJoin(rows).select("doc_id", "block_idx", "page_idx", "level", "number", "title"))
    assert [r[0] for r in got.groupBy("block_idx").count().where("count = 20000").orderBy("block_idx").collect()] == want
    assert got.count() == 20_000 * len(want)
    assert time.time() - began < 60
