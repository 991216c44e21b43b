"""Relational files, JSON that is swapped in, and events joined from chunks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliary.sources.readers import put_json, read_json
from foliary.sources.sqlite import SqliteReader, read_sqlite, write_sqlite
from foliary.streaming.stateful import joined_frames

from test_streams import Source, rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("relational"))
    made = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("na'me\" é%_"), F.col("id") % 7)).alias("name"), (F.col("id") / 4).alias("x"), (F.col("id") % 2 == 0).alias("flag"), F.encode(F.lit("é"), "utf-8").alias("raw"))
    write_sqlite(made.repartition(3), path, "ta\"ble")
    return made, lambda *scope: read_sqlite(spark, path, 'ta"ble', scope, split=100)


def test_files_hold_the_table(stored):
    made, read = stored
    found = read()
    assert found.dtypes == made.dtypes
    assert rows(found) == rows(made)
    assert found.rdd.getNumPartitions() >= 9  # ranges of row ids of three files
    assert rows(found.where("k = 17 or name like '%6'")) == rows(made.where("k = 17 or name like '%6'"))
    assert found.count() == 1000  # what one query leaves out is there for the next


@pytest.mark.parametrize(
    ("scope", "where"),
    [
        ([("k", "=", 17)], "k = 17"), ([("k", "in", [3, 5, 2000])], "k in (3, 5, 2000)"), ([("name", "=", None)], "name is null"), ([("name", "!=", None), ("x", ">=", 100.5)], "name is not null and x >= 100.5"),
        ([("name", "=", "na'me\" é%_3"), ("k", "<", 500)], "name = 'na\\'me\" é%_3' and k < 500"), ([("name", "starts", "na'")], "startswith(name, 'na\\'')"), ([("name", "contains", "%_5")], "contains(name, '%_5')"),
        ([("name", "!=", "x")], "not (name <=> 'x')"), ([("x", ">", 10), ("x", "<=", 11)], "x > 10 and x <= 11"), ([("k", "in", [])], "false"),
    ],
)
def test_a_scope_is_what_the_files_answer(stored, scope, where):
    made, read = stored
    assert rows(read(*scope)) == rows(made.where(where))


def test_a_scope_goes_into_the_files_queries(stored):
    found = stored[1]()
    reader = SqliteReader(found.schema, [], "t", 10, [("k", "=", 17), ("name", "=", None)])
    assert reader.where == ['"k" IS ?', '"name" IS NULL'] and reader.values == [17]
    for scope in ([("absent", "=", 1)], [("k", "; drop", 1)]):
        with pytest.raises((KeyError, ValueError)):
            SqliteReader(found.schema, [], "t", 10, scope)


def test_json_is_swapped_in(spark, tmp_path):
    path, schema = f"file://{tmp_path}/j", "k string, n long"
    one = put_json(spark.createDataFrame([("a", 1), ("b", 2)], schema), path, "k")
    with pytest.raises(Exception, match="stop"):
        put_json(spark.createDataFrame([("a", 3)], schema).withColumn("n", F.raise_error(F.lit("stop")).cast("long")), path, "k")
    assert rows(read_json(spark, path, "k", schema).select("k", "n")) == [("a", 1), ("b", 2)]
    put_json(spark.createDataFrame([("a", 3)], schema), path, "k")
    assert rows(read_json(spark, path, "k", schema).select("k", "n")) == [("a", 3), ("b", 2)]
    assert rows(read_json(spark, path, "k", schema, one).select("k", "n")) == [("a", 1), ("b", 2)]


CHUNKS = "job string, seq long, chunk binary"


def events(job, n, last):
    out = [{"stage": "running", "percent": k, "message": f"é漢 {job} {k}"} for k in range(n)]
    return [*out, {"stage": last, "percent": 100}] if last else out


def text(some):
    frames = [f"data: {json.dumps(e, ensure_ascii=False)}" for e in some]
    frames.insert(1, ": a comment")
    frames.insert(2, 'data: {"stage": "running",\ndata: "percent": 50}')
    return "\n\n".join([*frames, "data: not json", "data: [1]", ""]).encode()


def want(job, some):
    split = [some[0], {"stage": "running", "percent": 50}, *some[1:]]
    return [(job, k, e["stage"], e["percent"], e.get("message"), e["stage"] in ("completed", "failed")) for k, e in enumerate(split)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_same_events(spark, tmp_path, seed):
    rng = random.Random(seed)
    said = {"a": (events("a", 5, "completed"), b'data: {"stage": "running"}\n\n'), "b": (events("b", 4, None), b""), "c": (events("c", 3, "failed"), b'data: {"stage": "completed"}\n\n')}
    chunks, every = [], []
    for job, (some, after) in said.items():
        raw = text(some).replace(b"\n", b"\r\n") if job == "b" else text(some)
        raw, k = raw + after, 0
        while raw:
            n = rng.choice([1, 2, 3, 17, 200])
            chunks.append((job, k, bytearray(raw[:n])))
            raw, k = raw[n:], k + 1
        every += want(job, some)
    batch = joined_frames(spark.createDataFrame(chunks, CHUNKS).repartition(4))
    assert rows(batch) == sorted(every, key=repr)
    source = Source(spark, tmp_path, CHUNKS)
    for a, b in ((0, 0.3), (0.3, 0.6), (0.6, 1)):  # by place, so every job's frames are cut by the stops
        part = [c for c in chunks if a <= c[1] / (1 + max(x[1] for x in chunks if x[0] == c[0])) < b]
        source.add(part)
        found = source.run(joined_frames, "terminal")
    assert rows(found.select(*batch.columns)) == sorted(every, key=repr)
