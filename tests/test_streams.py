"""Streams in several batches with a stop between, against their batch twins; checkpoints that are resumed."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from foliary.operators import workflow
from foliary.operators.checkpoints import Checkpoints, once
from foliary.sources.versioned import VersionedTable
from foliary.streaming import stateful

DAY = datetime.datetime(2024, 1, 1)
at = lambda hours: DAY + datetime.timedelta(hours=hours)


class Source:
    """A folder of files, one for each batch; ``run`` starts the stream anew over what is there and lets it end."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.n += 1

    def run(self, make, key, mode="append"):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        out = make(stream)
        table = VersionedTable(self.spark, f"file://{self.folder}/out", key, out.schema)
        out.writeStream.outputMode(mode).foreachBatch(once(table, "s")).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
        return table.read().drop("v")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def requests(n, seed=3):
    rng = random.Random(seed)
    states = list(workflow.TRANSITIONS)[:7]
    return [(rng.choice([1, 1, 1, 2, 3, None]), at(k), k, rng.choice(states)) for k in range(n)]


def replayed(asked):
    state, out = {}, []
    for key, ts, k, to in sorted(asked, key=lambda r: r[1:3]):
        met = state.get(key, "INIT")
        legal = to in workflow.TRANSITIONS[met]
        out.append((key, ts, k, met, to, legal))
        state[key] = to if legal else met
    return sorted(out, key=repr)


REQUESTS = "user long, ts timestamp, id long, to_state string"


def test_audit_of_a_hot_key_over_many_ranges(spark):
    asked = requests(500)
    shuffled = spark.createDataFrame(random.Random(1).sample(asked, len(asked)), REQUESTS).repartition(7)
    found = workflow.audited(shuffled, workflow.TRANSITIONS, "user", ["ts", "id"])
    assert rows(found) == replayed(asked)
    assert workflow.audited(shuffled.limit(0), workflow.TRANSITIONS, "user", ["ts", "id"]).collect() == []


def test_audited_stream_goes_on_after_a_stop(spark, tmp_path):
    asked = [r for r in requests(90) if r[0] is not None]
    source = Source(spark, tmp_path, REQUESTS)
    make = lambda s: stateful.audited_stream(s, workflow.TRANSITIONS, "user", ["ts", "id"])
    source.add(asked[:30])
    source.run(make, "to_state")
    source.add(asked[30:45])
    source.add(asked[45:])
    found = source.run(make, "to_state").select("user", "ts", "id", "from_state", "to_state", "legal")
    twin = workflow.audited(spark.createDataFrame(asked, REQUESTS), workflow.TRANSITIONS, "user", ["ts", "id"])
    assert rows(found) == rows(twin) == replayed(asked)


BIN = "ref long, ts timestamp, kind string, purge_at timestamp, fails int"


def test_expiry_by_timers_is_the_batch(spark, tmp_path):
    day = lambda k: at(24 * k)
    one = [(1, day(0), "deleted", day(30), 0), (2, day(0), "deleted", day(30), 2), (3, day(1), "deleted", day(31), 3), (4, day(1), "deleted", day(31), 0), (5, day(2), "deleted", day(32), 9)]
    two = [(4, day(5), "restored", None, 0), (6, day(6), "deleted", day(36), 1)]
    three = [(4, day(7), "deleted", day(37), 0), (7, day(33), "deleted", day(63), 0)]
    four = [(8, day(50), "deleted", day(80), 0)]
    source = Source(spark, tmp_path, BIN)
    make = lambda s: stateful.expiring(s, "ref")
    every = []
    for batch, watermark in ((one, 2), (two, 6), (three, 33), (four, 50)):  # stopped and started again between
        source.add(batch)
        every += batch
        found = source.run(make, "status").select("ref", "status", "attempts")
        assert rows(found) == rows(stateful.expired_batch(spark.createDataFrame(every, BIN), "ref", str(day(watermark))))
    assert rows(found) == [(1, "purged", 1), (2, "purged", 3), (3, "conflict", 3), (4, "purged", 1), (5, "conflict", 3), (6, "purged", 2)]


EVENTS = "user long, ts timestamp, id long, value double"


def test_sessions_of_late_events_are_the_batch(spark, tmp_path):
    rng = random.Random(8)
    events = [(rng.randrange(3), at(rng.randrange(60) / 4 + k // 40 * 24), k, 1.0) for k in range(120)]
    source = Source(spark, tmp_path, EVENTS)
    for k in range(0, 120, 40):
        source.add(events[k : k + 40])  # in no order within a batch's day
    source.add([(99, at(400), 999, 0.0)])  # closes all windows
    source.add([(99, at(500), 1000, 0.0)])
    found = source.run(lambda s: stateful.sessions(s, "user", "30 minutes", "20 hours"), "n")
    twin = stateful.sessions(spark.createDataFrame(events, EVENTS), "user", "30 minutes")
    assert rows(found.where("user <> 99").select(*twin.columns)) == rows(twin)


def test_repeats_within_the_watermark_go(spark, tmp_path):
    source = Source(spark, tmp_path, EVENTS)
    source.add([(1, at(0), 1, 1.0), (1, at(0.1), 2, 1.0)])
    source.add([(1, at(0.5), 1, 1.0), (2, at(0.6), 3, 1.0)])
    found = source.run(lambda s: stateful.without_repeats(s, ["id"], "1 hour"), "user")
    source.add([(2, at(0.7), 3, 1.0), (2, at(0.8), 4, 1.0)])
    found = source.run(lambda s: stateful.without_repeats(s, ["id"], "1 hour"), "user")
    assert sorted(r["id"] for r in found.collect()) == [1, 2, 3, 4]


def test_a_join_of_streams_is_the_batch(spark, tmp_path):
    rng = random.Random(5)
    events = [(rng.randrange(4), at(k / 5), k, float(k % 2)) for k in range(80)]
    source = Source(spark, tmp_path, EVENTS)
    make = lambda s: stateful.followed(s.where("value = 0"), s.where("value = 1"), "user", "2 hours", "3 hours")
    source.add(events[:40])
    source.run(make, "user")
    source.add(events[40:])
    found = source.run(make, "user")
    twin = make(spark.createDataFrame(events, EVENTS))
    assert rows(found.select(*twin.columns)) == rows(twin)


def test_a_batch_played_again_writes_nothing_twice(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "user", EVENTS)
    batch = spark.createDataFrame([(1, at(0), 1, 1.0)], EVENTS)
    put = once(table, "s")
    for number in (0, 0, 1, 1, 0):
        put(batch, number)
    assert table.read().count() == 2


def test_what_has_succeeded_does_not_run_again(spark, tmp_path):
    held = Checkpoints(spark, f"file://{tmp_path}/c")
    items = spark.createDataFrame([(f"j{j}", f"i{i}") for j in range(3) for i in range(4)], "job string, item string")
    held.opened(items)
    assert {r["state"] for r in held.states().collect()} == {"idle"}
    good = lambda x: x.select("job", "item", F.lit("out").alias("output"), F.when(F.col("item") == "i1", "x" * 2000).alias("error"))
    held.run(good, items.where("job <> 'j2'").select("job").distinct())
    assert rows(held.states()) == [("j0", "error"), ("j1", "error"), ("j2", "idle")]
    assert max(len(r["error"] or "") for r in held.items().collect()) == 1000

    def dies(x):
        raise RuntimeError("the driver died")

    with pytest.raises(RuntimeError):
        held.run(dies)
    assert {r["state"] for r in held.states().collect()} == {"running"}
    again = Checkpoints(spark, f"file://{tmp_path}/c")  # another driver
    again.opened(items.union(spark.createDataFrame([("j9", "new")], "job string, item string")))
    assert again.pending().count() == 2 + 4 + 1 and again.items().where("state = 'running'").count() == 0
    again.run(lambda x: x.select("job", "item", F.lit("second").alias("output"), F.lit(None).cast("string").alias("error")))
    got = {(r["job"], r["item"]): (r["state"], r["attempts"], r["output"]) for r in again.items().collect()}
    assert got["j0", "i0"] == ("success", 1, "out") and got["j0", "i1"] == ("success", 3, "second")
    assert got["j2", "i0"] == ("success", 2, "second") and got["j9", "new"] == ("success", 1, "second")
    assert {r["state"] for r in again.states().collect()} == {"success"}
    again.reset(spark.createDataFrame([("j0", "i0")], "job string, item string"))
    assert [(r["item"], r["attempts"], r["output"]) for r in again.pending().collect()] == [("i0", 1, None)]


def test_expiry_keeps_a_state_row_a_group(spark, tmp_path):
    """Each item was a key, a state row and a timer of its own; here many of both share a group and its timer."""
    day = lambda k: at(24 * k)
    gone = [(k, day(k % 9), "deleted", day(k % 9 + 30), k % 5) for k in range(200)]
    back = [(k, day(10), "restored", None, 0) for k in range(0, 200, 7)]
    source = Source(spark, tmp_path, BIN)
    every = []
    for batch, watermark in ((gone, 8), (back, 10), ([(999, day(33), "deleted", day(90), 0)], 33)):
        source.add(batch)
        every += batch
        found = source.run(lambda s: stateful.expiring(s, "ref", groups=3), "status").select("ref", "status", "attempts")
        assert rows(found) == rows(stateful.expired_batch(spark.createDataFrame(every, BIN), "ref", str(day(watermark))))
    assert found.count() > 50
