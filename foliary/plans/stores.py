"""Queries over what has been stored: relational files, tables of JSON with versions, merges, event streams cut in chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliary.plans.catalog import query, t
from foliary.sources.readers import put_json, read_json
from foliary.sources.sqlite import read_sqlite, write_sqlite
from foliary.sources.versioned import VersionedTable, scratch
from foliary.streaming import stateful


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey >= 100 AND o_custkey IS NOT NULL")
def a14_relational_scan(spark, d):
    """The orders as relational files, and a scoped read of them: the files answer the filters."""
    path = scratch(spark, "relational")
    write_sqlite(t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus"), path, "orders")
    return read_sqlite(spark, path, "orders", [("o_orderstatus", "=", "F"), ("o_orderkey", ">=", 100), ("o_custkey", "!=", None)], 10_000)


@query("SELECT doc_id, lang, source, sha256(CASE WHEN source < 'src2' THEN text || '!' ELSE text END) AS digest FROM documents")
def a17_replaced_json(spark, d):
    """All texts as JSON by source, of which some sources are replaced; the others' files stay."""
    path, rows = scratch(spark, "json"), t(spark, d, "documents").select("doc_id", "lang", "text", "source")
    put_json(rows, path, "source")
    put_json(rows.where("source < 'src2'").withColumn("text", F.concat("text", F.lit("!"))), path, "source")
    return read_json(spark, path, "source", "doc_id long, lang string, text string, source string").select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest"))


FRAMED = "e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events), f AS (SELECT user_id, min(seq) AS last FROM e WHERE event_type = 'purchase' GROUP BY user_id)"


@query(f"WITH {FRAMED} SELECT e.user_id AS job, seq AS n, CASE event_type WHEN 'purchase' THEN 'completed' ELSE event_type END AS stage, CAST(event_id % 100 AS INTEGER) AS percent, 'é ' || event_id AS message, event_type = 'purchase' AS terminal FROM e LEFT JOIN f USING (user_id) WHERE last IS NULL OR seq <= last")
def a21_joined_frames(spark, d):
    """Each user's events as frames, cut anywhere into chunks; the events that come out up to the job's terminal stage."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    stage = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    body = F.to_json(F.struct(stage.alias("stage"), (F.col("event_id") % 100).cast("int").alias("percent"), F.concat(F.lit("é "), F.col("event_id").cast("string")).alias("message")))
    frame = F.concat(F.lit("data: "), body, F.lit("\n\n")).cast("binary")
    rows = t(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("seq"), frame.alias("frame"), F.lead("event_id").over(w).isNull().alias("last"))
    cut = (1 + F.col("event_id") % (F.octet_length("frame") - 2)).cast("int")
    head, tail = F.substring("frame", F.lit(1), cut), F.substring("frame", cut + 1, F.octet_length("frame"))
    ordered = Window.partitionBy("user_id").orderBy("seq")
    parts = rows.select("user_id", "seq", "last", tail.alias("tail"), F.concat(F.coalesce(F.lag(tail).over(ordered), F.lit(b"")), head).alias("chunk"))
    chunks = parts.select(F.col("user_id").alias("job"), F.inline(F.filter(F.array(F.struct("seq", "chunk"), F.struct((F.col("seq") + 1).alias("seq"), F.when(F.col("last"), F.col("tail")).alias("chunk"))), lambda x: x["chunk"].isNotNull())))
    return stateful.joined_frames(chunks)


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'moved' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey + 1000000000, c_nationkey, 'added' FROM customer WHERE c_custkey % 13 = 0")
def j4_merged_table(spark, d):
    """A stored table after one merge that changes, deletes and adds rows by nation."""
    rows = t(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("segment"))
    held = VersionedTable(spark, scratch(spark, "merged"), "c_nationkey", rows.schema)
    held.replace(rows)
    changed = rows.where("c_custkey % 7 = 0 or c_custkey % 11 = 0").withColumn("segment", F.lit("moved")).withColumn("gone", F.col("c_custkey") % 11 == 0)
    added = rows.where("c_custkey % 13 = 0").select("c_nationkey", (F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), F.lit("added").alias("segment"), F.lit(False).alias("gone"))
    held.merge(changed.unionByName(added), ["c_nationkey", "c_custkey"], "gone")
    return held.read().select("c_custkey", "c_nationkey", "segment")


@query("SELECT doc_id, 0 AS version, source, length(text) AS size FROM documents UNION ALL SELECT doc_id, 1, source, CASE WHEN source = 'src1' THEN 0 ELSE length(text) END FROM documents")
def j12_versions(spark, d):
    """Documents by source before and after one source was replaced: a read as of a version doesn't change."""
    rows = t(spark, d, "documents").select("source", "doc_id", F.length("text").cast("long").alias("size"))
    held = VersionedTable(spark, scratch(spark, "versions"), "source", rows.schema)
    first = held.replace(rows)
    second = held.replace(rows.where("source = 'src1'").withColumn("size", F.lit(0).cast("long")))
    at = lambda v, name: held.read(v).select("doc_id", F.lit(name).alias("version"), "source", "size")
    return at(first, 0).unionByName(at(second, 1))
