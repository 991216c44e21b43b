"""The versioned table: replace, append, merge, old versions, two writers, a job that dies."""

import pytest
from pyspark.sql import functions as F

from foliary.sources.versioned import ConflictError, VersionedTable, scratch

SCHEMA = "source string, id long, text string"


@pytest.fixture
def held(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", "source", SCHEMA)


def rows(table, version=None, keys=None):
    return sorted((tuple(r) for r in table.read(version, keys).select("source", "id", "text").collect()), key=repr)


def frame(spark, *r):
    return spark.createDataFrame(r, SCHEMA)


def test_replace_touches_only_its_keys(spark, held):
    assert rows(held) == []
    one = held.replace(frame(spark, ("a", 1, "x"), ("b", 2, "y"), (None, 3, "z"), ("a/b=c %", 4, "w")))
    files = lambda k: held.files.names(f"{held.path}/data/source={k}/v=*/*.parquet")
    before = files("b")
    two = held.replace(frame(spark, ("a", 9, "new")))
    assert files("b") == before  # not written again
    assert rows(held) == [("a", 9, "new"), ("a/b=c %", 4, "w"), ("b", 2, "y"), (None, 3, "z")]
    assert rows(held, one) == [("a", 1, "x"), ("a/b=c %", 4, "w"), ("b", 2, "y"), (None, 3, "z")]
    assert rows(held, keys=["a", None, "a/b=c %"]) == [("a", 9, "new"), ("a/b=c %", 4, "w"), (None, 3, "z")]
    assert held.versions() == [one, two]
    with pytest.raises(ValueError):
        held.read(99)


def test_two_writers_of_different_keys_keep_both(spark, held):
    held.replace(frame(spark, ("a", 1, "x"), ("b", 1, "x")))
    other = VersionedTable(spark, held.path, "source", SCHEMA)
    mine = held._write(frame(spark, ("a", 2, "mine")))
    base = held.manifest()["version"]
    other.replace(frame(spark, ("b", 2, "theirs")))  # commits between write and commit
    held._commit(mine, base, drop=True)
    assert rows(held) == [("a", 2, "mine"), ("b", 2, "theirs")]


def test_two_writers_of_one_key_conflict(spark, held):
    held.replace(frame(spark, ("a", 1, "x")))
    base, mine = held.manifest()["version"], held._write(frame(spark, ("a", 2, "mine")))
    held.replace(frame(spark, ("a", 3, "theirs")))
    with pytest.raises(ConflictError):
        held._commit(mine, base, drop=True)
    assert rows(held) == [("a", 3, "theirs")]


def test_merge_is_latest_wins(spark, held):
    first = held.replace(frame(spark, *[(s, k, f"{s}{k}") for s in "abc" for k in range(3)]))
    change = spark.createDataFrame([("a", 1, "changed", False), ("a", 7, "added", False), ("b", 0, None, True), ("c", 0, "", True), ("c", 1, "", True), ("c", 2, "", True)], SCHEMA + ", gone boolean")
    held.merge(change, ["source", "id"], "gone")
    assert rows(held) == [("a", 0, "a0"), ("a", 1, "changed"), ("a", 2, "a2"), ("a", 7, "added"), ("b", 1, "b1"), ("b", 2, "b2")]
    assert len(rows(held, first)) == 9


def test_a_failed_job_leaves_the_old_version(spark, held):
    held.replace(frame(spark, ("a", 1, "x")))
    broken = frame(spark, ("a", 2, "y")).withColumn("text", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        held.replace(broken)
    assert rows(held) == [("a", 1, "x")] and len(held.versions()) == 1


def test_a_tag_commits_once(spark, held):
    for number in (0, 0, 1, 0, 1):
        held.append(frame(spark, ("a", number, "x")), tag=("stream", number))
    held.append(frame(spark, ("a", 0, "y")), tag=("other", 0))
    assert rows(held) == [("a", 0, "x"), ("a", 0, "y"), ("a", 1, "x")]


def test_vacuum_keeps_what_the_last_versions_name(spark, held):
    for k in range(4):
        held.replace(frame(spark, ("a", k, "x")))
    held._write(frame(spark, ("a", 9, "never committed")))
    assert held.vacuum(keep=2) == 3
    assert rows(held) == [("a", 3, "x")] and rows(held, held.versions()[0]) == [("a", 2, "x")]


def test_scratch_is_in_a_shared_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert scratch(spark, "x").startswith(named or spark.conf.get("spark.sql.warehouse.dir"))
