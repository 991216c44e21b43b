"""Registered queries over the driver's tables, each with its SQL twin.

Stand-ins for the documents' own entities: a source is a tenant, a document's lines are its blocks and sections, the
items of orders are materials, events are workflow events. Each query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import chapters, files, relational, rules, search, templates, workflow
from foliary.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "d4_repeated_short_lines"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES = "lines AS (SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS block_idx, trim(u.x, ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) d, LATERAL (SELECT unnest(d.a) AS x, generate_subscripts(d.a, 1) AS i) u), blocks AS (SELECT doc_id, block_idx, block_idx // 20 AS page_idx, text FROM lines)"


@query("SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents")
def a1_landed_digests(spark, d):
    return t(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS joined, count(*) AS n FROM conversations GROUP BY conv_id")
def a4_ordered_concat(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("s"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), "\n\n").alias("joined"), F.count("*").alias("n"))


@query("SELECT doc_id, length(x) AS chars, sha256(x) AS digest FROM (SELECT doc_id, substr(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g'), 1, 20000) AS x FROM documents)")
def a9_fingerprint(spark, d):
    n, digest = files.fingerprint(F.col("text"))
    return t(spark, d, "documents").select("doc_id", n.cast("long").alias("chars"), digest.alias("digest"))


@query("SELECT doc_id, count(*) AS n_rows, sum(len(string_split(trim(regexp_replace(trim(l, ' '), '^\\||\\|$', '', 'g'), ' '), '|'))) AS cells FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE contains(l, '|') AND NOT regexp_matches(l, '^[ |:\\-]+$') GROUP BY doc_id")
def a12_pipe_tables(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.explode(T.markdown_rows(F.col("text"))).alias("r"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("r")).alias("cells"))


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src0' AND lang = 'en'")
def b1_scope_filter(spark, d):
    return relational.scoped(t(spark, d, "documents"), source="src0", lang="en").select("doc_id", "n_chars")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
def b2_visibility(spark, d):
    rows = t(spark, d, "customer").withColumn("project", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return relational.visible(rows, "project", "BUILDING").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%AR%' AND p_type = 'ECONOMY'")
def b4_optional_filters(spark, d):
    rows = t(spark, d, "part").withColumn("size_name", F.col("p_size").cast("string"))
    return relational.matching(rows, {"p_name": "AR", "p_brand": None}, {"p_type": ("ECONOMY", {"ECONOMY", "PROMO"}), "size_name": ("unknown", set())}).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01' AND o_orderstatus NOT IN ('restoring', 'conflict')")
def b8_expired(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("purge_at"))
    return relational.expired(rows, F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", F.col("status").alias("o_orderstatus"))


@query("SELECT c.c_custkey, coalesce(nullif(c.c_mktsegment, 'BUILDING'), n.n_name) AS agent FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def b16_fallback_value(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name").alias("agent"))


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3")
def c1_scoped_join(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer").where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def c15_unconfirmed(spark, d):
    done = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return relational.unresolved(t(spark, d, "customer"), done, "c_custkey").select("c_custkey")


@query("WITH b AS (SELECT doc_id, quality FROM labels), u AS (SELECT doc_id, CAST(toxic AS INTEGER) + 10 AS own, quality = 0 AS gone FROM labels WHERE toxic = 1) SELECT coalesce(b.doc_id, u.doc_id) AS doc_id, coalesce(u.own, b.quality) AS quality, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN u.own IS NULL THEN 'baseline' ELSE 'changed' END AS origin FROM b FULL JOIN u ON b.doc_id = u.doc_id WHERE NOT coalesce(u.gone, false)")
def c14_overrides(spark, d):
    rows = t(spark, d, "labels")
    user = rows.where("toxic = 1").select("doc_id", (F.col("toxic").cast("int") + 10).alias("quality"), (F.col("quality") == 0).alias("gone"))
    return relational.overridden(rows.select("doc_id", F.col("quality").cast("int").alias("quality")), user, "doc_id", "quality", "gone")


@query("WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents), k AS (SELECT s_suppkey AS pos, s_name AS name FROM supplier) SELECT p.doc_id, k.name FROM p JOIN k ON p.pos = k.pos AND p.pos <= 50")
def c21_positional_zip(spark, d):
    from pyspark.sql import Window

    rows = t(spark, d, "documents").withColumn("pos", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("pos <= 50")  # each task hands on 50 rows a source
    return rows.withColumn("pos", F.col("pos").cast("long")).join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name")), "pos").select("doc_id", "name")


@query("SELECT o.o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 30 DAY GROUP BY o.o_orderkey")
def c20_range_join(spark, d):
    o, l = t(spark, d, "orders").select("o_orderkey", "o_orderdate"), t(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return o.join(l, on).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, text, count(DISTINCT page_idx) AS pages, count(*) AS lines FROM blocks WHERE length(text) BETWEEN 1 AND 20 GROUP BY doc_id, text HAVING count(DISTINCT page_idx) >= 2")
def d4_repeated_short_lines(spark, d):
    return chapters.repeated_short_lines(chapters.blocks(t(spark, d, "documents")))


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (s = 'running') > 0 THEN 'running' WHEN count(*) FILTER (s = 'success') = count(*) THEN 'success' WHEN count(*) FILTER (s = 'error') > 0 THEN 'error' ELSE 'idle' END AS job_state, count(*) FILTER (s = 'running') AS n_running, count(*) FILTER (s = 'success') AS n_success, count(*) FILTER (s = 'error') AS n_error, count(*) FILTER (s = 'idle') AS n_idle FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'running' ELSE 'error' END AS s FROM orders) GROUP BY o_custkey")
def d10_job_state(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "running").otherwise("error")
    return relational.roll_up(t(spark, d, "orders").select("o_custkey", state.alias("state")), "o_custkey")


@query("SELECT doc_id, term, CAST((length(text) - length(replace(text, term, ''))) / length(term) AS BIGINT) AS n FROM documents, (VALUES ('idiot'), ('clown'), ('worthless')) w(term) WHERE contains(text, term)")
def d13_forbidden_terms(spark, d):
    return templates.occurrences(t(spark, d, "documents"), spark.createDataFrame([("idiot",), ("clown",), ("worthless",)], "term string"), "doc_id")


@query("SELECT l_partkey, count(DISTINCT l_returnflag) AS n_values, count(DISTINCT l_orderkey) AS n_chapters FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
def d14_inconsistent_fields(spark, d):
    return templates.inconsistent(t(spark, d, "lineitem"), "l_partkey", "l_orderkey", "l_returnflag")


@query("SELECT source, arg_min(doc_id, n_chars * 1000000 + doc_id) AS first_doc, min(n_chars) AS n_chars FROM documents GROUP BY source")
def d23_first_wins(spark, d):
    return relational.first_wins(t(spark, d, "documents").select("source", "n_chars", "doc_id"), "source", ["n_chars", "doc_id"]).select("source", F.col("doc_id").alias("first_doc"), "n_chars")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS value, count(DISTINCT o_orderpriority) > 1 AS needs_manual FROM orders GROUP BY o_custkey")
def d25_decided_value(spark, d):
    return templates.decided(t(spark, d, "orders"), "o_custkey", "o_orderpriority", ["o_orderkey"])


@query("WITH f AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS prio, 'File ' || (doc_id // 3) || '-' || (doc_id % 3) || '.' || CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'doc' END AS stored_name FROM documents) SELECT stored_name, 'file ' || (doc_id // 3) AS stem, prio = min(prio) OVER (PARTITION BY doc_id // 3) AS is_primary, count(*) OVER (PARTITION BY doc_id // 3) AS formats FROM f")
def e1_primary_file(spark, d):
    ext = F.element_at(F.array(F.lit("pdf"), F.lit("docx"), F.lit("doc")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = t(spark, d, "documents").select(F.concat(F.lit("File "), F.expr("doc_id div 3"), F.lit("-"), F.col("doc_id") % 3, F.lit("."), ext).alias("stored_name"))
    return files.grouped(rows).select("stored_name", "stem", "is_primary", "formats")


TREE = f"WITH {LINES}, h AS (SELECT doc_id, block_idx, page_idx, CAST(1 + length(text) % 4 AS INTEGER) AS level FROM blocks WHERE length(text) BETWEEN 1 AND 60)"


@query(TREE + ", x AS (SELECT a.*, (SELECT max(b.block_idx) FROM h b WHERE b.doc_id = a.doc_id AND b.block_idx < a.block_idx AND b.level < a.level) AS parent, (SELECT arg_min(b.page_idx, b.block_idx) FROM h b WHERE b.doc_id = a.doc_id AND b.block_idx > a.block_idx AND b.level <= a.level) AS nxt, max(page_idx) OVER (PARTITION BY doc_id) AS last_page FROM h a) SELECT doc_id, block_idx, level, coalesce(parent, -1) AS parent, CASE WHEN nxt IS NULL THEN last_page ELSE greatest(page_idx, nxt - 1) END AS end_page, row_number() OVER (PARTITION BY doc_id, parent ORDER BY block_idx) AS seq FROM x")
def e5_chapter_tree(spark, d):
    rows = chapters.blocks(t(spark, d, "documents")).where(F.length("text").between(1, 60)).withColumn("level", (1 + F.length("text") % 4).cast("int"))
    return chapters.tree(rows).select("doc_id", "block_idx", "level", F.coalesce("parent", F.lit(-1)).alias("parent"), "end_page", "seq")


@query(f"WITH {LINES}, c AS (SELECT *, CASE WHEN length(text) BETWEEN 1 AND 12 THEN text END AS cat FROM blocks), f AS (SELECT doc_id, block_idx, last_value(cat IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS category FROM c) SELECT * FROM f WHERE category IS NOT NULL")
def e6_carried_category(spark, d):
    rows = chapters.blocks(t(spark, d, "documents")).withColumn("cat", F.when(F.length("text").between(1, 12), F.col("text")))
    return rules.carried(rows, "doc_id", "block_idx", "cat").select("doc_id", "block_idx", "category")


@query("SELECT l_orderkey, arg_max(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS l_partkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def e7_latest_version(spark, d):
    return relational.latest(t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(1 + coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at FROM lineitem")
def e9_bookmarks(spark, d):
    rows = t(spark, d, "lineitem").withColumn("pages", F.col("l_quantity").cast("long"))
    return relational.cumulative_start(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "pages").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "starts_at")


@query("WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, before FROM e WHERE before IS NOT NULL AND before <> event_type")
def e10_broken_chains(spark, d):
    return workflow.broken_chains(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "event_type").select("event_id", "user_id", "before")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def f3_top_ten(spark, d):
    return t(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("WITH b AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'O'))) AS n, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F'))) AS o FROM orders GROUP BY o_custkey) SELECT o_custkey, len(list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(o, []), x))) AS added, len(list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(n, []), x))) AS removed FROM b")
def g3_config_change(spark, d):
    pick = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = t(spark, d, "orders").groupBy("o_custkey").agg(pick("O").alias("new"), pick("F").alias("old"))
    return rows.select("o_custkey", *relational.array_change("new", "old")).select("o_custkey", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"))


@query("SELECT p_partkey, regexp_replace(p_name, '[ \\t.:,;()]', '', 'g') AS title_key, lower(regexp_replace(regexp_replace(p_name, '^[0-9. ]+', ''), ' +', '', 'g')) AS chapter_key FROM part")
def h1_title_keys(spark, d):
    return t(spark, d, "part").select("p_partkey", T.title_key(F.col("p_name")).alias("title_key"), T.chapter_key(F.col("p_name")).alias("chapter_key"))


@query("SELECT item_id, count(DISTINCT doc_id) AS docs FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '[ \\t\\n\\r]+', '', 'g'), regexp_replace(b.text, '[ \\t\\n\\r]+', '', 'g')) GROUP BY item_id")
def h2_anchor_check(spark, d):
    docs, items = t(spark, d, "documents"), t(spark, d, "benchmark").select("item_id", T.squeeze(F.col("text")).alias("snippet"))
    found = templates.holding(docs, "doc_id", T.squeeze(F.col("text")), items, F.col("snippet")).select("doc_id", F.col("term").alias("snippet"))
    return found.join(items, "snippet").groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), '[ ]+', ' ', 'g'), ' ') AS cleaned FROM documents")
def h19_clean_text(spark, d):
    return t(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'changqi' END AS valid_until FROM orders")
def h28_compact_date(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return t(spark, d, "orders").select("o_orderkey", T.compact_date(raw).alias("valid_until"))


@query("WITH x AS (SELECT doc_id, lower(text) AS l FROM documents), f AS (SELECT count(*) AS n, count(*) FILTER (contains(l, 'ation')) AS df, avg(greatest(length(l) - 2, 0)) AS m FROM x), s AS (SELECT doc_id, (length(l) - length(replace(l, 'ation', ''))) / 5.0 AS tf, greatest(length(l) - 2, 0) AS size FROM x WHERE contains(l, 'ation')) SELECT doc_id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m)), 4) + 0.0 AS rank FROM s, f")
def i1_ranked_search(spark, d):
    found = search.bm25(t(spark, d, "documents"), "doc_id", "text", "ation")
    return found.select(F.col("id").alias("doc_id"), (F.round("rank", 4) + F.lit(0.0)).alias("rank"))


@query("SELECT gram, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(a) - 1, 1)), lambda i: a[i] || a[i + 1] || a[i + 2])) AS gram FROM (SELECT doc_id, string_split(lower(text), '') AS a FROM documents)) GROUP BY ALL) GROUP BY gram")
def i1_postings(spark, d):
    return search.postings(t(spark, d, "documents"), "doc_id", "text").groupBy("gram").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


@query("SELECT regexp_replace(p_name, ' .*$', '') AS name, count(*) AS items, min(p_retailprice) AS best FROM part GROUP BY 1")
def d19_candidate_groups(spark, d):
    rows = t(spark, d, "part").select(F.concat(F.regexp_replace("p_name", " .*$", ""), F.lit("_P"), F.col("p_size")).alias("name"), F.col("p_retailprice").alias("rank"))
    return search.candidate_groups(rows, "name", "rank")


@query("SELECT user_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id")
def k7_last_progress(spark, d):
    rows = t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return progress.last_by_key(rows, "user_id", "at", "event_type").select("user_id", "event_type", "events")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def x1_windowed_events(spark, d):
    return progress.windowed(t(spark, d, "events")).withColumn("total", F.round("total", 2))


@query("SELECT p_partkey, contains(p_type, 'STEEL') OR contains(p_type, 'BRASS') OR contains(p_type, 'TIN') AS external FROM part")
def b10_external_flag(spark, d):
    words = F.array(F.lit("STEEL"), F.lit("BRASS"), F.lit("TIN"))
    return t(spark, d, "part").select("p_partkey", F.exists(words, lambda w: F.contains("p_type", w)).alias("external"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS selected, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS missing FROM orders GROUP BY o_custkey")
def d7_status_counts(spark, d):
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(s == "O").alias("pending"), F.count_if(s == "F").alias("selected"), F.count_if(~s.isin("O", "F")).alias("missing"))


@query("SELECT greatest((SELECT max(o_orderkey) FROM orders), (SELECT max(l_orderkey) FROM lineitem)) + 1 AS next_seq")
def d20_next_seq(spark, d):
    used = t(spark, d, "orders").select(F.col("o_orderkey").alias("seq")).unionByName(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq")))
    return used.agg((F.max("seq") + 1).alias("next_seq"))


@query(f"WITH {LINES} SELECT doc_id, CAST(max(page_idx) + 1 AS BIGINT) AS page_count FROM blocks GROUP BY doc_id")
def d22_page_count(spark, d):
    return chapters.blocks(t(spark, d, "documents")).groupBy("doc_id").agg((F.max("page_idx") + 1).cast("long").alias("page_count"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS found FROM orders GROUP BY o_custkey")
def d24_found_categories(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("found"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def e8_without_repeats(spark, d):
    return workflow.without_repeats(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def f1_page(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_totalprice")


@query("WITH u AS (SELECT c_nationkey AS nation, 0 AS src, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_nationkey, 1, s_suppkey, s_name FROM supplier) SELECT nation, arg_min(name, src * 1000000000000 + k) AS name FROM u GROUP BY nation")
def g1_ordered_union(spark, d):
    one = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit(0).alias("src"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    two = t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit(1).alias("src"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return relational.first_wins(one.unionByName(two), "nation", ["src", "k"]).select("nation", "name")


@query("SELECT p_partkey, p_name || CASE WHEN n = 1 THEN '' ELSE '-' || (n - 1) END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def h17_unique_names(spark, d):
    return files.unique_names(t(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "name")


@query("SELECT l_orderkey, l_partkey, l_suppkey, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '_' || l_partkey AS key FROM lineitem")
def h27_section_keys(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.concat_ws("_", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), "l_partkey").alias("key"))


@query("SELECT doc_id, CAST(0 AS DOUBLE) AS rank FROM documents WHERE contains(lower(text), 'or')")
def i3_short_search(spark, d):
    return search.bm25(t(spark, d, "documents"), "doc_id", "text", "or").withColumnRenamed("id", "doc_id")


@query("WITH u AS (SELECT c_custkey AS k, c_name AS name, 0 AS v FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) SELECT k, arg_max(name, v) AS name, max(v) AS v FROM u GROUP BY k")
def j4_upsert(spark, d):
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(0).alias("v"))
    new = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit(1).alias("v"))
    return relational.latest(old.unionByName(new), ["k"], [F.col("v")])


@query("SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 'active' ELSE 'deprecated' END AS status FROM lineitem")
def j5_deprecated_versions(spark, d):
    return relational.deprecated(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_partkey", "l_suppkey", "status")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 AND o_orderstatus = 'O' THEN TIMESTAMP '2000-01-01' END AS deleted_at FROM orders")
def j1_soft_delete(spark, d):
    rows = t(spark, d, "orders").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return relational.soft_delete(rows, (F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") == "O"), F.lit("2000-01-01").cast("timestamp")).select("o_orderkey", "deleted_at")
