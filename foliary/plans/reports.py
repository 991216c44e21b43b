"""Registered queries of counts, roll-ups, orders, sets, search and mutations over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import chapters, relational, rules, search, sections, templates, workflow
from foliary.plans.catalog import LINES, query, t
from foliary.plans.domain import TENDER, X, rows
from foliary.plans.records import BIN, MOVES, ROUNDS, O, bin_table, moves, orders, rounds


@query(X + ", p AS (SELECT doc, count(*) FILTER (kind IN (5, 6, 7, 8, 11)) AS headings, count(*) AS leaders FROM x GROUP BY doc) SELECT doc AS doc_id FROM p WHERE headings >= 4 OR leaders >= 4")
def d2_contents_pages(spark, d):
    """A page a document, all of whose lines end in a page number."""
    x = rows(spark, d, "part", TENDER).select(F.col("doc").alias("doc_id"), F.lit(0).alias("page_idx"), F.concat("text", F.lit(" .... "), "n").alias("text"))
    return chapters.toc_pages(x).select("doc_id")


@query("SELECT doc_id, CAST(k AS INTEGER) AS block_idx FROM documents, range(6) r(k) WHERE k < 4 AND (doc_id % 2 = 1 OR k = 0)")
def d3_stacked_headings(spark, d):
    """Pages with three bare titles lose them: even documents have four, odd ones two and two numbered headings."""
    names = F.when(F.col("doc_id") % 2 == 0, F.array(*[F.lit(x) for x in ("1.1 范围", "封面", "投标函", "授权委托书", "合同条款", "正文。")])).otherwise(F.array(*[F.lit(x) for x in ("1.1 范围", "封面", "投标函", "1.2 依据", "正文。", "说明：")]))
    x = t(spark, d, "documents").select("doc_id", F.posexplode(names).alias("block_idx", "text")).withColumn("page_idx", F.lit(0))
    return chapters.headings(x).select("doc_id", "block_idx")


@query("SELECT doc_id, CAST(k AS INTEGER) AS block_idx FROM documents, range(5) r(k) WHERE k IN (0, 2, 4) OR (k = 3 AND doc_id % 2 = 0)")
def e3_running_headers(spark, d):
    """Titles A A B A A on pages 0 1 1 4 8: a repeat within three pages of a kept one goes, so what is kept decides."""
    odd = F.col("doc_id") % 2 == 1
    pages = [F.lit(0), F.lit(1), F.lit(1), F.when(odd, 3).otherwise(4), F.lit(8)]
    heads = F.array(*[F.struct(F.lit(k).alias("block_idx"), p.alias("page_idx"), F.lit(x).alias("title")) for k, (p, x) in enumerate(zip(pages, "甲甲乙甲甲", strict=True))])
    x = t(spark, d, "documents").select("doc_id", F.inline(heads)).withColumns({"level": F.lit(1), "number": F.lit("")})
    return chapters.without_running_headers(x).select("doc_id", "block_idx")


@query("SELECT count(*) AS total FROM part WHERE p_name ILIKE '%a%'")
def d5_total(spark, d):
    return relational.matching(t(spark, d, "part"), {"p_name": "a"}, {}).agg(F.count("*").alias("total"))


@query("SELECT p_brand, p_type, count(*) AS versions FROM part GROUP BY p_brand, p_type")
def d6_version_counts(spark, d):
    return t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("versions"))


@query(f"WITH {O} SELECT owner, count(*) AS items, count(*) FILTER (status = 'selected') AS done, bool_or(status = 'missing') AS any_missing, coalesce(len(list_distinct(list(name) FILTER (status = 'pending'))), 0) AS open_names FROM o GROUP BY owner")
def d11_artefact_summary(spark, d):
    x = orders(spark, d).groupBy("owner").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "selected").alias("done"), F.bool_or(F.col("status") == "missing").alias("any_missing"), F.size(F.collect_set(F.when(F.col("status") == "pending", F.col("name")))).cast("long").alias("open_names"))
    return x.select("owner", "items", "done", "any_missing", "open_names")


PLACES = "p AS (SELECT l_orderkey AS chapter, CASE WHEN l_returnflag = 'A' THEN 'image' ELSE 'a_class' END AS type, l_linestatus = 'F' AS missing, l_quantity > 25 AS manual, l_partkey AS name FROM lineitem), w AS (SELECT chapter, name, CASE WHEN missing AND type = 'image' THEN 'missing_image' WHEN missing THEN 'missing_text' WHEN manual THEN 'b_class_uncertain' END AS problem FROM p)"


def places(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.when(F.col("l_returnflag") == "A", "image").otherwise("a_class").alias("type"), (F.col("l_linestatus") == "F").alias("missing"), (F.col("l_quantity") > 25).alias("manual"), F.col("l_partkey").alias("name"))


@query(f"WITH {PLACES} SELECT * FROM w WHERE problem IS NOT NULL")
def d27_warnings(spark, d):
    return templates.warnings(places(spark, d))


@query(f"WITH {PLACES} SELECT problem, count(*) AS n, count(DISTINCT chapter) AS chapters FROM w WHERE problem IS NOT NULL GROUP BY problem")
def d12_warning_counts(spark, d):
    return templates.warnings(places(spark, d)).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("chapter").alias("chapters"))


FOUND = "f AS (SELECT o_orderkey AS id, o_custkey AS report, CASE o_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'open' END AS status FROM orders)"


def answered(spark, d):
    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("report"), F.lit("open").alias("status"))
    action = F.when(F.col("id") % 4 == 0, "accept").when(F.col("id") % 4 == 1, "reject")
    return relational.resolved(x, x.where("id % 4 < 2").select("id", action.alias("action")), "id")


@query(f"WITH {FOUND} SELECT id, status FROM f")
def j10_resolved_findings(spark, d):
    return answered(spark, d).select("id", "status")


@query(f"WITH {FOUND} SELECT report, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected FROM f GROUP BY report")
def d16_finding_counts(spark, d):
    return answered(spark, d).groupBy("report").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"))


@query(f"WITH {LINES}, h AS (SELECT doc_id, 1 + length(text) % 4 AS level, min(1 + length(text) % 4) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM blocks WHERE length(text) BETWEEN 1 AND 60) SELECT doc_id, count(*) AS sections, count(*) FILTER (up IS NULL OR up >= level) AS chapters FROM h GROUP BY doc_id")
def d18_chapter_counts(spark, d):
    x = chapters.blocks(t(spark, d, "documents")).where(F.length("text").between(1, 60)).withColumn("level", (1 + F.length("text") % 4).cast("int"))
    return chapters.tree(x).groupBy("doc_id").agg(F.count("*").alias("sections"), F.count_if(F.col("parent").isNull()).alias("chapters"))


EDITS = "e AS (SELECT o_custkey AS k, arg_max(CASE o_orderkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'remove' ELSE 'reset' END, o_orderkey) AS op, arg_max(o_orderpriority, o_orderkey) AS new FROM orders GROUP BY o_custkey), m AS (SELECT coalesce(c.c_custkey, e.k) AS k, CASE WHEN e.op IN ('add', 'update') THEN e.new ELSE c.c_mktsegment END AS title, coalesce(e.op, 'base') AS op FROM (SELECT * FROM customer WHERE c_custkey % 3 > 0) c FULL JOIN e ON e.k = c.c_custkey), r AS (SELECT * FROM m WHERE op <> 'remove' AND title IS NOT NULL)"


def edited(spark, d):
    base = t(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("title"))
    op = F.element_at(F.array(*[F.lit(x) for x in ("add", "update", "remove", "reset")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return relational.edited_list(base, t(spark, d, "orders").select(F.col("o_custkey").alias("k"), op.alias("op"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("at")), "k")


@query(f"WITH {EDITS} SELECT * FROM r")
def j11_edited_list(spark, d):
    return edited(spark, d)


@query(f"WITH {EDITS} SELECT count(*) AS items, count(*) FILTER (op = 'base') AS untouched, count(*) FILTER (op IN ('add', 'update')) AS own FROM r")
def d21_list_counters(spark, d):
    return edited(spark, d).agg(F.count("*").alias("items"), F.count_if(F.col("op") == "base").alias("untouched"), F.count_if(F.col("op").isin("add", "update")).alias("own"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS name, p_size + CASE WHEN p_size % 3 = 0 AND p_brand <> p_name THEN 1 ELSE 0 END AS version FROM part")
def d26_bumped_versions(spark, d):
    x = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("version"), "p_brand")
    return relational.bumped(x.drop("p_brand"), x.where("version % 3 = 0").select("k", F.col("p_brand").alias("name")), "k")


@query(f"WITH {O}, s AS (SELECT owner, CASE WHEN count(*) FILTER (status = 'missing') > 0 THEN 'running' WHEN count(*) FILTER (status = 'selected') = count(*) THEN 'success' ELSE 'idle' END AS job FROM o GROUP BY owner), {FOUND}, g AS (SELECT report, count(*) FILTER (status = 'open') AS open FROM f GROUP BY report) SELECT owner, job, open FROM s JOIN g ON owner = report")
def d29_status_report(spark, d):
    state = F.when(F.col("status") == "missing", "running").when(F.col("status") == "selected", "success").otherwise("idle")
    jobs = relational.roll_up(orders(spark, d).withColumn("state", state), "owner").select("owner", F.col("job_state").alias("job"))
    found = answered(spark, d).groupBy(F.col("report").alias("owner")).agg(F.count_if(F.col("status") == "open").alias("open"))
    return jobs.join(found, "owner")


@query("SELECT l_orderkey AS chapter, array_to_string(list(DISTINCT l_partkey ORDER BY l_partkey), ',') AS objects FROM lineitem WHERE l_discount > 0.05 GROUP BY l_orderkey")
def d30_crossing_objects(spark, d):
    """Boxes whose lower edge lies below the page, here those of a discount over a twentieth."""
    y1 = F.when(F.col("l_discount") > 0.05, -1.0).otherwise(1.0)
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_partkey").alias("obj"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), y1).alias("bbox")).distinct()
    return sections.crossing(x, "chapter").select("chapter", F.array_join("objects", ",").alias("objects"))


@query("SELECT user_id, event_id, CASE WHEN lead(ts) OVER w IS NULL THEN NULL ELSE greatest(0, date_diff('second', ts, lead(ts) OVER w) - 1) END AS lasts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def e8_ends_before_next(spark, d):
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.timestamp_diff("SECOND", F.date_trunc("second", "ts"), F.date_trunc("second", nxt)) - 1
    return t(spark, d, "events").select("user_id", "event_id", F.when(nxt.isNotNull(), F.greatest(F.lit(0), gap)).alias("lasts"))


SPANS = f"WITH {LINES}, h AS (SELECT doc_id AS source, block_idx, 1 + length(text) % 4 AS level FROM blocks WHERE length(text) BETWEEN 1 AND 60), l AS (SELECT doc_id AS source, max(block_idx) AS last FROM blocks GROUP BY doc_id)"


@query(SPANS + " SELECT h.source, h.block_idx, h.block_idx + 1 AS first, coalesce((SELECT min(n.block_idx) FROM h n WHERE n.source = h.source AND n.block_idx > h.block_idx AND n.level <= h.level), l.last + 1) AS stop FROM h JOIN l ON l.source = h.source")
def e11_subtree_spans(spark, d):
    b = chapters.blocks(t(spark, d, "documents")).withColumn("last_idx", F.max("block_idx").over(Window.partitionBy("doc_id")))
    heads = b.where(F.length("text").between(1, 60)).select(F.col("doc_id").alias("source"), "block_idx", (1 + F.length("text") % 4).cast("int").alias("level"), "last_idx")
    return sections.subtree_spans(heads).select("source", "block_idx", "first", "stop")


@query("SELECT p_partkey, CAST(least(90, 10 + CAST(round_even(80 * p_size / 50.0, 0) AS INTEGER)) AS INTEGER) AS percent FROM part")
def e12_progress(spark, d):
    return t(spark, d, "part").withColumn("total", F.lit(50)).select("p_partkey", workflow.progress(10.0, 90.0, "p_size", "total").alias("percent"))


@query("SELECT p_partkey FROM part ORDER BY p_brand, p_type, p_name, p_size DESC, p_partkey LIMIT 50")
def f2_mixed_order(spark, d):
    return t(spark, d, "part").orderBy("p_brand", "p_type", "p_name", F.desc("p_size"), "p_partkey").limit(50).select("p_partkey")


@query("WITH x AS (SELECT doc_id, lower(text) AS l FROM documents), f AS (SELECT count(*) AS n, count(*) FILTER (contains(l, 'ation')) AS df, avg(greatest(length(l) - 2, 0)) AS m FROM x), s AS (SELECT doc_id, (length(l) - length(replace(l, 'ation', ''))) / 5.0 AS tf, greatest(length(l) - 2, 0) AS size FROM x WHERE contains(l, 'ation')) SELECT doc_id AS id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m)), 4) + 0.0 AS rank FROM s, f ORDER BY -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m)), doc_id LIMIT 10")
def f4_best_hits(spark, d):
    return search.best(search.bm25(t(spark, d, "documents"), "doc_id", "text", "ation"), 10).select("id", (F.round("rank", 4) + F.lit(0.0)).alias("rank"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def f7_newest(spark, d):
    x = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return relational.latest(x, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT DISTINCT source, 'file ' || (doc_id // 3) AS stem FROM documents")
def f8_distinct_stems(spark, d):
    name = F.concat(F.lit("File "), F.expr("doc_id div 3"), F.lit("-"), F.col("doc_id") % 3, F.lit(".docx"))
    return t(spark, d, "documents").select("source", T.file_stem(name).alias("stem")).distinct().orderBy("source", "stem")


@query("SELECT doc_id, substr(text, 1, 200) AS excerpt, list_slice(string_split(text, chr(10)), 1, 30) AS first_lines FROM documents")
def f9_fixed_caps(spark, d):
    return t(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("excerpt"), F.slice(F.split("text", "\n"), 1, 30).alias("first_lines"))


@query("SELECT 'quality' AS rule, doc_id FROM labels WHERE quality = 0 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1")
def g2_union_of_matches(spark, d):
    x = t(spark, d, "labels")
    return x.where("quality = 0").select(F.lit("quality").alias("rule"), "doc_id").unionByName(x.where("toxic = 1").select(F.lit("toxic").alias("rule"), "doc_id"))


CONFIG = "c AS (SELECT p_partkey AS id, p_size % 2 = 0 AS all_required, p_size % 3 = 0 AS strange, p_size % 5 = 0 AS bond FROM part)"


def configs(spark, d):
    n = F.col("p_size")
    names = F.concat(F.slice(F.array(*[F.lit(x) for x in workflow.REQUIRED]), F.lit(1), F.when(n % 2 == 0, 8).otherwise(7)), F.when(n % 3 == 0, F.array(F.lit("strange"))).otherwise(F.array().cast("array<string>")), F.when(n % 5 == 0, F.array(F.lit("bid_bond"))).otherwise(F.array().cast("array<string>")))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), names.alias("chosen"))


@query(f"WITH {CONFIG} SELECT id, CASE WHEN strange THEN 'strange' ELSE '' END AS unknown, CASE WHEN all_required THEN '' ELSE 'invalid_bid' END AS missing FROM c")
def g4_config_faults(spark, d):
    unknown, missing = workflow.config_faults(F.col("chosen"))
    return configs(spark, d).select("id", F.array_join(unknown, ",").alias("unknown"), F.array_join(missing, ",").alias("missing"))


@query(f"WITH {CONFIG} SELECT id, 18 AS items, 8 + CAST(bond AS INTEGER) AS chosen FROM c")
def h37_merged_config(spark, d):
    """Names that were given are on; required ones are on by default, and what isn't known is dropped."""
    given = F.map_from_arrays("chosen", F.transform("chosen", lambda _: F.lit(True)))
    m = workflow.merged_config(given)
    return configs(spark, d).select("id", F.size(m).alias("items"), F.size(F.filter(F.map_values(m), lambda v: v)).alias("chosen"))


@query(f"WITH {CONFIG} SELECT id, CASE WHEN bond THEN 'bid_bond' ELSE '' END AS added, CASE WHEN bond OR id % 2 = 1 THEN 4 ELSE 0 END AS affected, id % 2 = 1 AS switched FROM c")
def g3_h38_config_change(spark, d):
    base = F.array(*[F.lit(x) for x in workflow.REQUIRED])
    new = F.array_union(base, F.filter("chosen", lambda x: x == "bid_bond"))
    x = configs(spark, d).withColumn("c", workflow.config_change(new, base, {"llm": (F.col("id") % 2 == 1, F.lit(False))}))
    return x.select("id", F.array_join("c.added", ",").alias("added"), F.size(workflow.affected(F.col("c"), ["llm"])).alias("affected"), F.col("c.llm").isNotNull().alias("switched"))


@query(f"WITH {CONFIG} SELECT id, CASE WHEN bond THEN 'extract:coarse' ELSE '' END AS items FROM c")
def g5_affected_items(spark, d):
    """What a change resets of the items that a job has."""
    base = F.array(*[F.lit(x) for x in workflow.REQUIRED])
    change = workflow.config_change(F.array_union(base, F.filter("chosen", lambda x: x == "bid_bond")), base, {})
    have = F.array(F.lit("dedupe"), F.lit("extract:coarse"))
    return configs(spark, d).select("id", F.array_join(F.array_intersect(workflow.affected(change, []), have), ",").alias("items"))


@query("SELECT l_orderkey, l_linenumber, 'a' AS template FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_linenumber, 'n' FROM lineitem WHERE l_returnflag = 'N'")
def g7_union_of_chapters(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    one = lambda flag: x.where(F.col("l_returnflag") == flag).select("l_orderkey", "l_linenumber", F.lit(flag.lower()).alias("template"))
    return one("A").unionByName(one("N"))


@query("SELECT 'extract:' || r_regionkey AS item FROM region UNION ALL SELECT 'score:' || n_nationkey FROM nation UNION ALL SELECT 'docx:' || s_suppkey FROM supplier")
def g8_checklist_items(spark, d):
    ids = [("region", "extract:", "r_regionkey"), ("nation", "score:", "n_nationkey"), ("supplier", "docx:", "s_suppkey")]
    one, two, three = (t(spark, d, name).select(F.concat(F.lit(p), c).alias("item")) for name, p, c in ids)
    return one.unionByName(two).unionByName(three)


@query("SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS purge_at FROM orders")
def h29_purge_dates(spark, d):
    return t(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("purge_at"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) / 4 AS x, round_even(p_size / 4.0, 0) AS y FROM part")
def h31_rounded(spark, d):
    """Quarters are exact in binary, so SQL's half to even agrees; the tests have values that aren't."""
    return t(spark, d, "part").select("p_partkey", (F.col("p_size") / 4).alias("x"), templates.rounded(F.col("p_size") / 4, F.lit(0)).alias("y"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_size END AS n, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 'high' END AS risk FROM part")
def h34_fenced_json(spark, d):
    body = F.concat(F.lit('{"risk": "high", "n": '), F.col("p_size"), F.lit("}"))
    reply = F.element_at(F.array(F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```")), F.concat(F.lit("```\n"), body, F.lit("\n```")), body, F.lit("not json")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", T.fenced_json(reply, "risk string, n int").alias("j")).select("p_partkey", "j.n", "j.risk")


@query("SELECT l_orderkey, concat_ws(', ', CASE WHEN max(l_quantity) > 40 THEN 'score: out of 0..100' END, CASE WHEN count(*) % 2 = 1 THEN 'total: not as expected' END) AS faults FROM lineitem GROUP BY l_orderkey")
def h35_score_faults(spark, d):
    item = F.struct(F.lit("n").alias("name"), (F.when(F.col("l_quantity") > 40, 101.0).otherwise(50.0)).alias("score"))
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.struct((F.count("*") % 2 * 1.0).alias("total"), F.lit(0.0).alias("expected"), F.collect_list(item).alias("items")).alias("table"))
    return x.select("l_orderkey", F.array_join(rules.score_faults(F.col("table")), ", ").alias("faults"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 2 = 1")
def h36_tolerant_json(spark, d):
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{broken")
    return t(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json(broken), "$.k", "bigint"), F.lit(-1)).alias("k"))


@query("SELECT p_partkey, p_brand AS agency, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS title FROM part")
def h39_merged_meta(spark, d):
    old, new = F.create_map(F.lit("agency"), "p_brand", F.lit("title"), "p_name"), F.create_map(F.lit("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""), F.lit("agency"), F.lit(None).cast("string"))
    m = relational.merged_meta(old, new)
    return t(spark, d, "part").select("p_partkey", m["agency"].alias("agency"), m["title"].alias("title"))


@query(f"WITH RECURSIVE {LINES}, h AS (SELECT doc_id, block_idx, CAST(1 + length(text) % 4 AS INTEGER) AS level FROM blocks WHERE length(text) BETWEEN 1 AND 60), p AS (SELECT a.*, (SELECT max(b.block_idx) FROM h b WHERE b.doc_id = a.doc_id AND b.block_idx < a.block_idx AND b.level < a.level) AS parent FROM h a), w AS (SELECT doc_id, block_idx, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.block_idx, w.depth + 1 FROM p JOIN w ON w.doc_id = p.doc_id AND w.block_idx = p.parent) SELECT doc_id, block_idx, CAST(depth AS INTEGER) AS ancestors FROM w")
def h33_ancestors(spark, d):
    x = chapters.blocks(t(spark, d, "documents")).where(F.length("text").between(1, 60)).withColumn("level", (1 + F.length("text") % 4).cast("int"))
    return chapters.with_ancestors(x).select("doc_id", "block_idx", F.size("ancestors").alias("ancestors"))


HEADED = "h AS (SELECT doc_id, block_idx, text, CAST(1 + length(text) % 4 AS INTEGER) AS level FROM blocks WHERE length(text) BETWEEN 1 AND 60), p AS (SELECT a.*, (SELECT max(b.block_idx) FROM h b WHERE b.doc_id = a.doc_id AND b.block_idx < a.block_idx AND b.level < a.level) AS parent FROM h a), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY block_idx) AS seq FROM p)"


@query(f"WITH RECURSIVE {LINES}, {HEADED}, w AS (SELECT doc_id, block_idx, 'ch' || seq AS chapter_id, text AS path, 0 AS depth FROM s WHERE parent IS NULL UNION ALL SELECT s.doc_id, s.block_idx, w.chapter_id || '.' || s.seq, w.path || '/' || s.text, w.depth + 1 FROM s JOIN w ON w.doc_id = s.doc_id AND w.block_idx = s.parent) SELECT doc_id, block_idx, chapter_id, path, CAST(depth AS INTEGER) AS depth FROM w")
def e4_chapter_numbers(spark, d):
    x = chapters.blocks(t(spark, d, "documents")).where(F.length("text").between(1, 60)).withColumn("level", (1 + F.length("text") % 4).cast("int"))
    return chapters.numbered(x, title="text").select("doc_id", "block_idx", "chapter_id", "path", "depth")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE lower(substr(text, 1, 3)) END AS gram FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND length(text) >= 3")
def i1_index_upserts(spark, d):
    """Every seventh document is removed and every third one changed to a text without trigrams; the first gram of the others stays."""
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 3).alias("text"), F.lit(None).cast("timestamp").alias("deleted_at"))
    index = search.upserted(search.rebuilt(x), x.where("id % 3 = 0").select("id", F.lit("x").alias("text")), x.where("id % 7 = 0"))
    return index.select(F.col("id").alias("doc_id"), "gram")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 0 ELSE 3 END AS changes FROM part")
def i6_changed_lines(spark, d):
    other = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("!")))
    return t(spark, d, "part").select("p_partkey", templates.changes(F.col("p_name"), other).alias("changes"))


@query("WITH x AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, len(p) AS whole, CAST(len(p) > 1 AS INTEGER) + len(p) - CAST(len(p) > 1 AS INTEGER) AS same, greatest(len(p) - 1, 0) AS tail FROM x")
def i5_common_subsequence(spark, d):
    x = t(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda z: z["o_orderpriority"]).alias("p"))
    lcs = templates.common_subsequence
    tail = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    return x.select("o_custkey", F.size("p").cast("long").alias("whole"), lcs("p", "p").cast("long").alias("same"), lcs("p", tail).cast("long").alias("tail"))


@query(f"WITH {BIN} SELECT ref_id, CASE WHEN ref_id % 7 = 0 THEN 'absent' WHEN ref_id % 5 = 0 THEN 'not deleted' WHEN tenant = '3' THEN 'parent deleted' ELSE 'restored' END AS outcome FROM b")
def j2_restored(spark, d):
    b = bin_table(spark, d).withColumnRenamed("tenant", "parent")
    target = b.where("ref_id % 7 <> 0").select("ref_id", F.when(F.col("ref_id") % 5 != 0, F.col("deleted_at")).alias("deleted_at"))
    return relational.restored(b, target, b.where("parent <> '3'").select("parent"))


DUE = "purge_at <= TIMESTAMP '1996-01-01' AND status NOT IN ('restoring', 'conflict')"


@query(f"WITH {BIN} SELECT ref_id, CASE WHEN {DUE} THEN 'conflict' ELSE status END AS status FROM b WHERE NOT ({DUE}) OR ref_id % 13 = 0")
def j3_purged_bin(spark, d):
    b = bin_table(spark, d)
    failed = b.where("ref_id % 13 = 0 or ref_id % 17 = 0").select("ref_id", F.when(F.col("ref_id") % 13 == 0, 3).otherwise(2).alias("attempts"))
    return relational.purged(b, b, F.lit("1996-01-01").cast("timestamp"), failed)[1].select("ref_id", "status")


@query(f"WITH {BIN} SELECT count(*) AS stay FROM b WHERE NOT ({DUE})")
def k8_expiry_sweep(spark, d):
    """One run of the hourly sweep; the schedule is a trigger's."""
    b = bin_table(spark, d)
    return relational.purged(b, b, F.lit("1996-01-01").cast("timestamp"))[0].agg(F.count("*").alias("stay"))


@query("SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM orders")
def j6_j12_replaced(spark, d):
    x = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    return relational.replaced(x.withColumn("v", F.lit("old")), x.where("k % 2 = 0").withColumn("v", F.lit("new")), "k")


@query(f"WITH {ROUNDS} SELECT id, owner, status, round, owner % 2 = 0 AS gone FROM r UNION ALL SELECT id + 1000000000, owner, 'pending', round, false FROM r WHERE owner % 2 = 0")
def j7_regenerated(spark, d):
    x = rounds(spark, d)
    fresh = x.where("owner % 2 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "owner", F.lit("pending").alias("status"), "round")
    found = relational.regenerated(x.withColumn("deleted_at", F.lit(None).cast("timestamp")), fresh, "owner", F.lit("2000-01-01").cast("timestamp"))
    return found.select("id", "owner", "status", "round", F.col("deleted_at").isNotNull().alias("gone"))


@query(f"WITH {O} SELECT id, CASE WHEN id % 3 = 0 THEN 'renamed' ELSE name END AS name FROM o WHERE id % 5 <> 0 UNION ALL SELECT id + 1000000000, name FROM o WHERE id % 4 = 0")
def j9_item_changes(spark, d):
    """Items added, renamed and removed as one view: the last change of each wins."""
    x = orders(spark, d).select("id", "name", F.lit(0).alias("at"), F.lit(False).alias("gone"))
    log = x.unionByName(x.where("id % 3 = 0").select("id", F.lit("renamed").alias("name"), F.lit(1).alias("at"), "gone")).unionByName(x.where("id % 5 = 0").select("id", "name", F.lit(2).alias("at"), F.lit(True).alias("gone")))
    log = log.unionByName(x.where("id % 4 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "name", "at", "gone"))
    return relational.latest(log, ["id"], [F.col("at")]).where("not gone").select("id", "name")


@query("SELECT DISTINCT category, value FROM (SELECT 'custom' AS category, p_brand AS value FROM part UNION ALL SELECT 'custom', p_type FROM part WHERE p_size > 10) WHERE NOT starts_with(value, 'S')")
def j13_dictionary(spark, d):
    x = t(spark, d, "part")
    word = lambda df, c: df.select(F.lit("custom").alias("category"), F.col(c).alias("value")).distinct()
    added = word(x.where("p_size > 10"), "p_type")
    gone = word(x, "p_type").unionByName(word(x, "p_brand")).where("startswith(value, 'S')")
    return relational.merged_words(word(x, "p_brand"), added, gone)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'closed' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 10 <> 0")
def j14_plain_changes(spark, d):
    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    changed = x.where("id % 6 = 0").select("id", F.lit("closed").alias("status"))
    return relational.replaced(x, changed, "id").join(x.where("id % 10 = 0").select("id"), "id", "left_anti")


LOG = "i AS (SELECT user_id AS job, event_type AS stage, count(*) FILTER (event_id % 4 = 0) AS attempts, ['running', 'success', 'error', 'idle'][arg_max(event_id, event_id) % 4 + 1] AS state FROM events GROUP BY ALL)"


def checkpoint(spark, d):
    state = F.element_at(F.array(*[F.lit(x) for x in ("running", "success", "error", "idle")]), (F.col("event_id") % 4 + 1).cast("int"))
    return workflow.attempts(t(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), "event_id", state.alias("state")), ["job", "stage"], ["event_id"])


@query(f"WITH {LOG} SELECT * FROM i")
def k2_checkpoint_items(spark, d):
    return checkpoint(spark, d)


@query(f"WITH {LOG} SELECT job, stage, CASE WHEN state IN ('running', 'error') THEN 'idle' ELSE state END AS state FROM i")
def k3_retried(spark, d):
    return workflow.retried(checkpoint(spark, d)).select("job", "stage", "state")


DAG = ", ".join(f"('{a}', '{b}')" for a, to in workflow.STAGES.items() for b in to)
NAMES = sorted({*workflow.STAGES, "confirmed"})
CASCADE = f"e(a, b) AS (VALUES {DAG}), n(stage) AS (VALUES {', '.join(f'({x!r})' for x in NAMES)}), w AS (SELECT stage, stage AS below FROM n UNION SELECT w.stage, e.b FROM w JOIN e ON e.a = w.below)"


@query(f"WITH RECURSIVE {CASCADE}, j AS (SELECT c_custkey AS job, {NAMES}[c_nationkey % {len(NAMES)} + 1] AS again FROM customer) SELECT job, n.stage, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.stage = j.again AND w.below = n.stage) THEN 'idle' ELSE 'success' END AS state FROM j, n")
def k4_cascades(spark, d):
    """Jobs of which one stage each is reset; the confirmation (K5) is a stage like others, below all."""
    names = F.array(*[F.lit(x) for x in NAMES])
    jobs = t(spark, d, "customer").select(F.col("c_custkey").alias("job"), F.element_at(names, (F.col("c_nationkey") % len(NAMES) + 1).cast("int")).alias("stage"))
    items = jobs.select("job", F.explode(names).alias("stage")).withColumn("state", F.lit("success"))
    return workflow.reset(items, jobs, workflow.below(spark))


@query(f"WITH RECURSIVE {CASCADE}, r AS (SELECT DISTINCT o_custkey AS job, {NAMES}[o_orderkey % {len(NAMES)} + 1] AS stage FROM orders WHERE o_orderstatus = 'F') SELECT job, bool_or(r.stage <> 'confirmed') AS upstream, count(*) AS resets FROM r JOIN w ON w.stage = r.stage AND w.below = 'confirmed' GROUP BY job")
def k5_confirmation_resets(spark, d):
    """Jobs whose confirmation a reset takes away: of it or of any stage before it, by the edges' closure."""
    names = F.array(*[F.lit(x) for x in NAMES])
    resets = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("job"), F.element_at(names, (F.col("o_orderkey") % len(NAMES) + 1).cast("int")).alias("stage"))
    found = workflow.invalidated(resets, workflow.below(spark), "confirmed")
    return found.select("job", "upstream", "resets")


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events), f AS (SELECT user_id, min(seq) AS last FROM e WHERE event_type IN ('purchase', 'refund') GROUP BY user_id) SELECT e.user_id AS job, e.event_id, CAST(seq AS INTEGER) AS seq, event_type AS stage FROM e LEFT JOIN f USING (user_id) WHERE last IS NULL OR seq <= last")
def k9_event_sequence(spark, d):
    found = workflow.until_terminal(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["purchase", "refund"])
    return found.select(F.col("user_id").alias("job"), "event_id", "seq", F.col("event_type").alias("stage"))


ORDER = ["PARSE_CONFIRMED", "FORMAT_REVIEW", "FORMAT_CONFIRMED", "MATERIAL_LOOP"]


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 = 4 THEN 'unknown' WHEN c_nationkey % 5 >= 2 THEN 'already' WHEN c_nationkey % 5 = 1 THEN 'enter' ELSE 'not reached' END AS outcome FROM customer")
def k10_stage_gates(spark, d):
    state = F.element_at(F.array(*[F.lit(x) for x in [*ORDER, "INIT"]]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return t(spark, d, "customer").select("c_custkey", workflow.gate(state, F.lit("FORMAT_CONFIRMED"), ORDER).alias("outcome"))


@query(f"WITH {MOVES}, f AS (SELECT *, EXISTS (SELECT 1 FROM e WHERE e.a = from_state AND e.b = to_state) AS legal FROM s) SELECT event_id, CASE WHEN legal THEN to_state ELSE from_state END AS state, CASE WHEN legal THEN 'moved' ELSE 'kept' END AS entry FROM f")
def k11_rollback(spark, d):
    """A failed move leaves the state as it was, and its audit row is kept besides."""
    x = workflow.legal(moves(spark, d), workflow.edges(spark))
    return x.select("event_id", F.when(F.col("legal"), F.col("to_state")).otherwise(F.col("from_state")).alias("state"), F.when(F.col("legal"), "moved").otherwise("kept").alias("entry"))


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, n_chars >= 9000 AND row_number() OVER (ORDER BY n_chars DESC, doc_id) = 1 AS best FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def f3_best_ten(spark, d):
    x = t(spark, d, "documents").select(F.lit(0).alias("k"), "doc_id", F.col("n_chars").alias("score"), F.col("doc_id").alias("pos"))
    top = x.orderBy(F.desc("score"), "pos").limit(10)
    return templates.best_templates(top, "k", 10, 9000).select("doc_id", F.col("score").alias("n_chars"), "rank", F.col("is_best").alias("best"))


@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS seq FROM part")
def f5_f6_sequences(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_name", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).alias("seq"))
