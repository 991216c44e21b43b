"""Queries that run as streams over the given tables, to their end, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import workflow
from foliary.operators.checkpoints import Checkpoints, once
from foliary.plans.catalog import ORACLES, query, t
from foliary.plans.records import moves
from foliary.sources.versioned import VersionedTable, scratch
from foliary.streaming import progress, stateful


def stream(spark, d, name):
    # A table is one file or a folder of them; as a pattern either is a source.
    return spark.readStream.schema(t(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def stored(df, key, mode="append"):
    """Runs a stream over all there is into a versioned table and reads that."""
    spark = df.sparkSession
    table = VersionedTable(spark, scratch(spark, "sink"), key, df.schema)
    df.writeStream.outputMode(mode).foreachBatch(once(table, "query")).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return table.read().drop("v")


@query(ORACLES["k1_audited_moves"])
def k1_streamed_moves(spark, d):
    asked = moves(spark, d, stream(spark, d, "events")).select("user_id", "ts", "event_id", "to_state")
    return stored(stateful.audited_stream(asked, workflow.TRANSITIONS, "user_id", ["ts", "event_id"]), "to_state").select("event_id", "user_id", "from_state", "to_state", "legal")


@query("WITH i AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS job, event_type AS item, user_id FROM events) SELECT job, item, 'success' AS state, CASE WHEN user_id % 3 = 0 OR user_id % 5 = 1 THEN 2 ELSE 1 END AS attempts, job || ' ' || CASE WHEN user_id % 3 = 0 OR user_id % 5 = 1 THEN 'second' ELSE 'first' END AS output FROM i")
def k2_resumed_run(spark, d):
    """A run in which a third of the jobs fail and a fifth is never heard of again, then one that takes up what is left."""
    items = t(spark, d, "events").select(F.col("user_id").cast("string").alias("job"), F.col("event_type").alias("item")).distinct()
    held = Checkpoints(spark, scratch(spark, "checkpoints"))
    held.opened(items)
    said = lambda name: F.concat_ws(" ", "job", F.lit(name)).alias("output")
    held.run(lambda x: x.where("job % 5 <> 1").select("job", "item", said("first"), F.when(F.col("job") % 3 == 0, "refused").alias("error")))
    held.opened(items)
    held.run(lambda x: x.select("job", "item", said("second"), F.lit(None).cast("string").alias("error")))
    return held.items().select("job", "item", "state", "attempts", "output")


@query(ORACLES["k7_last_progress"])
def k7_streamed_progress(spark, d):
    rows = stored(stream(spark, d, "events"), "event_type").withColumn("at", F.struct("ts", "event_id"))
    return progress.last_by_key(rows, "user_id", "at", "event_type").select("user_id", "event_type", "events")


BIN_EVENTS = "e AS (SELECT o_orderkey AS ref_id, o_orderdate AS ts, o_orderdate + INTERVAL 30 DAY AS purge_at, o_orderkey % 5 AS fails FROM orders)"


def bin_events(orders):
    return orders.select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("deleted").alias("kind"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("purge_at"), (F.col("o_orderkey") % 5).cast("int").alias("fails"))


@query(f"WITH {BIN_EVENTS} SELECT ref_id, CASE WHEN fails < 3 THEN 'purged' ELSE 'conflict' END AS status, CAST(least(fails + 1, 3) AS INTEGER) AS attempts FROM e WHERE purge_at + INTERVAL 1 SECOND * ((least(fails + 1, 3) - 1) * 5) <= (SELECT max(ts) FROM e)")
def k8_streamed_expiry(spark, d):
    return stored(stateful.expiring(bin_events(stream(spark, d, "orders")), "ref_id"), "status").select("ref_id", "status", "attempts")


@query("WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o) SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS until, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k")
def x2_sessions(spark, d):
    return stateful.sessions(t(spark, d, "events"), "user_id", "6 hours").withColumn("total", F.round("total", 2))


@query("SELECT user_id, event_type, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY ALL")
def x3_without_repeats(spark, d):
    rows = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return stateful.without_repeats(rows, ["user_id", "event_type", "day"]).groupBy("user_id", "event_type").agg(F.count("*").alias("days"))


@query("SELECT a.user_id, a.event_id AS first_id, a.ts AS first_ts, b.event_id AS second_id, b.ts AS second_ts FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR")
def x4_followed(spark, d):
    rows = t(spark, d, "events").withColumnRenamed("event_id", "id")
    return stateful.followed(rows.where("event_type = 'view'"), rows.where("event_type = 'purchase'"), "user_id", "12 hours")
