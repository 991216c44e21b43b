"""Cases that operators once got wrong: rows without ids of their own, long texts, many small groups."""

import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliary.llm import ngram_jaccard, pieces, quality, sharding, topk


def colliding(n):
    """Two texts of n words and one length and crc32: the checksum is linear, so some mix of swapped words keeps it."""
    import zlib

    rng = np.random.default_rng(0)
    seen = {}
    while True:
        text = " ".join(rng.choice(["aa", "bb", "cc", "dd"], n))
        crc = zlib.crc32(text.encode()) & 0xFFFF
        if seen.setdefault(crc, text) != text:
            return text, seen[crc]


def test_op9_rows_without_ids_keep_their_own_sets(spark):
    long, short = "one two three four five six seven eight nine ten eleven twelve", "a b c d e f g h"
    rows = [(None, long), (None, short), (None, long), (7, short + " i"), (7, "x " * 30), (None, None)]
    got = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["n_shingles"], r["component"] or 0) for r in got) == sorted(
        [(True, 0, 8, 0), (True, 0, 8, 0), (True, 0, 4, 7), (False, 7, 5, 7), (False, 7, 1, 7), (True, 0, 0, 0)]
    )


def test_op9_identity_is_the_row_not_a_hash(spark):
    one, two = colliding(40)
    rows = spark.createDataFrame([(None, one), (None, two)] * 3, "doc_id long, text string")
    sizes = [len({tuple(t.split()[i : i + 5]) for i in range(36)}) for t in (one, two)]
    got = sorted(r["n_shingles"] for r in ngram_jaccard.ngram_jaccard_join(rows).collect())
    assert got == sorted(sizes * 3)


def test_op6_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.75, 0.0]), (2, []), (3, [0.0, 0.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 786432), (1, 524288), (2, 0), (3, 0)]


def test_op10_one_long_text_does_not_empty_its_class(spark):
    good, bad = "The quiet river flows past the old mill. ", "$$## 11 @@ zz!! "
    texts = [(k, (good if k % 2 else bad) * (3 + k % 5), k % 2) for k in range(400)]
    hashed = spark.createDataFrame([(k,) for k, _, _ in texts], "id long").where(~quality.held_out("id")).orderBy(F.xxhash64("id"))
    first = next(r["id"] for r in hashed.collect() if r["id"] % 2)
    texts = [(k, good * 425_000 if k == first else t, y) for k, t, y in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string, y int")
    model = quality.learn(docs, docs.select("doc_id", F.col("y").alias("quality")))
    scores = {r["id"]: r["score"] for r in quality.quality_scores(docs.where(f"doc_id <> {first}"), model).collect()}
    assert min(scores[k] for k in scores if k % 2) > 0.9 > 0.1 > max(scores[k] for k in scores if k % 2 == 0)


def sharded(found, capacity):
    shards, keys = defaultdict(int), defaultdict(set)
    slots = defaultdict(list)
    for r in found.collect():
        shards[r["shard"]] += r["size"]
        keys[r["crc"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert max(shards.values()) <= capacity and all(len(v) == 1 for v in keys.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sorted(shards) == list(range(len(shards)))
    return len(shards), sum(shards.values())


@pytest.mark.parametrize(("n", "capacity"), [(60_000, 2_100), (20_000, 200), (3_000, 10)])
def test_op5_small_texts_under_any_capacity(spark, monkeypatch, n, capacity):
    monkeypatch.setattr(sharding, "SLICE", 9_000)
    monkeypatch.setattr(sharding, "RANGE", 4_000)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("%08d", "id").alias("text"))
    shards, total = sharded(sharding.shard_documents(docs, capacity=capacity), capacity)
    fits = capacity // 9 * 9
    assert shards <= 1.15 * total / fits + 8


def test_op5_capacity_with_groups_of_all_sizes(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("t"), (F.col("id") % 500).cast("string")), (F.col("id") % 500 % 90 + 1).cast("int")).alias("text"))
    shards, total = sharded(sharding.shard_documents(docs, capacity=8_000), 8_000)
    assert shards <= 1.1 * total / 8_000 + 2
    with pytest.raises(ValueError, match="larger than"):
        sharding.shard_documents(docs, capacity=100)
    assert sharding.shard_documents(docs.limit(0), capacity=100).collect() == []


def test_op1_cuts_a_long_text_in_one_pass():
    text = "▁" + "word é漢 " * 4_000_000  # about 50 MB
    batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([text])], names=["id", "row", "text"])
    began = time.time()
    parts = [b.to_pylist()[0] for b in pieces._cut(8192, 48)(iter([batch]))]
    assert time.time() - began < 20
    assert "".join(p["text"][p["a"] : p["b"]] for p in parts) == text
    assert all(p["k"] == k for k, p in enumerate(parts)) and parts[1]["a"] == 48
