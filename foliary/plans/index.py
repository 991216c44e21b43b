"""Queries of the phrase index: search by tenant, overlapping hits, and search after upserts, removals and a merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators.phrase_index import PhraseIndex
from foliary.plans.catalog import query, t
from foliary.sources.versioned import scratch

# Documents of a tenant with a name of their own; grams are three characters of the lower-case text.
NAMED = "n AS (SELECT coalesce(source, '') AS tenant, doc_id AS id, lower(CASE WHEN doc_id % 3 = 0 THEN 'Station ' || lang ELSE lang END) AS name, lower(coalesce(text, '')) AS text FROM documents)"


def _search(phrase: str, table: str = "n") -> str:
    """Hits one after another, each looked for from one character behind the last one's start, so overlapping ones count
    each; figures of each tenant by itself."""
    return f"""b AS (SELECT tenant, id, name AS x FROM {table} UNION ALL SELECT tenant, id, text FROM {table}),
w AS (SELECT tenant, id, substr(x, instr(x, '{phrase}') + 1) AS rest FROM b WHERE contains(x, '{phrase}') UNION ALL SELECT tenant, id, substr(rest, instr(rest, '{phrase}') + 1) FROM w WHERE contains(rest, '{phrase}')),
h AS (SELECT tenant, id, count(*) AS hits FROM w GROUP BY tenant, id),
c AS (SELECT tenant, id, greatest(length(name) - 2, 0) + greatest(length(text) - 2, 0) AS size, coalesce(hits, 0) AS hits FROM {table} LEFT JOIN h USING (tenant, id)),
f AS (SELECT tenant, count(*) AS n, avg(size) AS mean, count(*) FILTER (hits > 0) AS df FROM c GROUP BY tenant),
r AS (SELECT c.tenant, c.id, c.hits, ln((n - df + 0.5) / (df + 0.5)) AS idf, size / mean AS len FROM c JOIN f ON c.tenant = f.tenant WHERE hits > 0)
SELECT tenant, id AS doc_id, CAST(hits AS BIGINT) AS hits, round(-(CASE WHEN idf > 0 THEN idf ELSE 1e-6 END) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * len)), 6) + 0.0 AS rank FROM r"""


def named(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Station "), F.col("lang"))).otherwise(F.col("lang"))
    return t(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("tenant"), F.col("doc_id").alias("id"), name.alias("name"), "text")


def index(spark):
    return PhraseIndex(spark, scratch(spark, "index"), ["name", "text"])


def shown(found):
    return found.select("tenant", F.col("id").alias("doc_id"), "hits", (F.round("rank", 6) + F.lit(0.0)).alias("rank"))


@query(f"WITH RECURSIVE {NAMED}, {_search('ation')}")
def i2_phrase_search(spark, d):
    held = index(spark)
    held.rebuild(named(spark, d))
    return shown(held.search("ATION"))


@query(f"WITH RECURSIVE {NAMED}, {_search('anan')}")
def i2_overlapping_hits(spark, d):
    held = index(spark)
    held.rebuild(named(spark, d))
    return shown(held.search("anan"))


CHANGED = f"WITH RECURSIVE {NAMED}, m AS (SELECT tenant, id, name, CASE WHEN id % 5 = 0 THEN text || ' anan nation' ELSE text END AS text FROM n WHERE id % 7 <> 0 OR id % 5 = 0 UNION ALL SELECT tenant, id + 1000000000, 'added', text FROM n WHERE id % 11 = 0)"


def _changed(spark, d):
    """An index that was built, in which whole texts were changed (id % 5), others removed (id % 7) and new ones added (id % 11)."""
    x = named(spark, d)
    held = index(spark)
    held.rebuild(x)
    held.upsert(x.where("id % 11 = 0").select("tenant", (F.col("id") + 1_000_000_000).alias("id"), F.lit("added").alias("name"), "text"), x.where("id % 7 = 0"))
    held.upsert(x.where("id % 5 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" anan nation"))))
    return held


@query(f"{CHANGED}, {_search('anan', 'm')}")
def i1_upserts_then_search(spark, d):
    return shown(_changed(spark, d).search("anan"))


@query(f"{CHANGED}, {_search('ation', 'm')}")
def i1_merged_then_search(spark, d):
    held = _changed(spark, d)
    held.merged(most=1, drop=True)
    return shown(held.search("ation"))
