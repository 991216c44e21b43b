"""Registered queries of scoped tables, joins, checkpoints and the workflow, over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import chapters, files, relational, rules, search, sections, templates, workflow
from foliary.plans.catalog import LINES, query, t
from foliary.plans.domain import TENDER, X, rows
from foliary.sources import docx, readers


def orders(spark, d, *more):
    """Orders as items of customers: key, status, a name, when deleted."""
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.element_at(F.create_map(F.lit("F"), F.lit("selected"), F.lit("O"), F.lit("pending"), F.lit("P"), F.lit("missing")), F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("name"), *more)


O = "o AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'selected' WHEN 'O' THEN 'pending' ELSE 'missing' END AS status, o_orderpriority AS name, o_orderkey, o_orderdate, o_totalprice FROM orders)"  # noqa: E741


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 AS ok, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS text, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS page_idx FROM part")
def a2_block_lists(spark, d):
    good = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("p_name").alias("text"), F.col("p_size").alias("page_idx"))))
    x = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, good).otherwise('{"type": "text"}').alias("json"))
    b = readers.parsed_blocks(F.col("json"))
    return x.select("id", b.isNotNull().alias("ok"), F.try_element_at(b, F.lit(1))["text"].alias("text"), F.try_element_at(b, F.lit(1))["page_idx"].alias("page_idx"))


@query("SELECT d.source, count(*) AS docs, sum(length(d.text) - length(replace(d.text, chr(10), '')) + 1) AS blocks FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY d.source")
def a3_union_of_sources(spark, d):
    done = t(spark, d, "labels").where("quality = 1").select("doc_id")
    docs = t(spark, d, "documents").join(done, "doc_id", "left_semi")
    return chapters.blocks(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("blocks"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a5_missing_sources(spark, d):
    return relational.missing(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT p_partkey AS stem, CASE WHEN p_partkey % 3 = 0 THEN concat('out/', p_partkey, '/auto') WHEN p_partkey % 2 = 0 THEN concat('out/', p_partkey) ELSE 'out' END AS path, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS source FROM part")
def a7_located_outputs(spark, d):
    x = t(spark, d, "part").select(F.col("p_partkey").alias("stem"))
    near = x.where("stem % 3 = 0").withColumn("path", F.concat(F.lit("out/"), "stem", F.lit("/auto")))
    mid = x.where("stem % 2 = 0").withColumn("path", F.concat(F.lit("out/"), "stem"))
    return relational.first_source("stem", near, mid, x.withColumn("path", F.lit("out")))


DOCX = "WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM benchmark), p AS (SELECT item_id, pos, trim(regexp_replace(line, ' +', ' ', 'g'), ' ') AS text FROM l) SELECT item_id, CAST(pos AS INTEGER) AS pos, text FROM p WHERE text <> ''"


@query(DOCX)
def a10_docx_paragraphs(spark, d):
    """Texts written as docx files, in memory, and read back."""
    made = docx.written(t(spark, d, "benchmark"), "item_id", "text")
    return docx.paragraphs(made, "item_id").where("kind = 'paragraph'").select("item_id", "pos", "text")


@query("SELECT l_orderkey, l_returnflag AS category, l_partkey AS item, concat('m', l_suppkey) AS material FROM lineitem")
def a13_requirements(spark, d):
    """Nested score tables, as JSON, exploded to their requirements."""
    item = F.struct(F.col("l_partkey").alias("name"), F.array(F.concat(F.lit("m"), "l_suppkey")).alias("materials"))
    per = t(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(item).alias("items"))
    docs = per.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_returnflag").alias("name"), "items")).alias("categories"))).alias("json"))
    return readers.requirements(docs, "l_orderkey", "json").select("l_orderkey", "category", F.col("item").cast("long").alias("item"), "material")


@query("SELECT p_partkey AS id, 'custom' AS category, p_name AS value FROM part UNION ALL SELECT p_partkey, 'person_names', p_brand FROM part WHERE p_partkey % 2 = 0")
def a15_keyword_lists(spark, d):
    names = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand"))
    json = F.to_json(F.struct(F.array("p_name").alias("custom"), names.alias("person_names"), F.lit(1).alias("unknown")))
    return readers.parsed_keywords(t(spark, d, "part").select(F.col("p_partkey").alias("id"), json.alias("json")), "id", "json")


@query("SELECT c_custkey AS id, c_custkey AS project FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey + 1000000000, 7 FROM supplier")
def a20_imported(spark, d):
    own = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("project"))
    return own.unionByName(t(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.lit(7).cast("long").alias("project")))


@query("SELECT conv_id, turn, role AS stage, CAST(turn AS INTEGER) AS percent, role = 'completed' AS terminal FROM conversations")
def a21_event_frames(spark, d):
    frame = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("role").alias("stage"), F.col("turn").alias("percent"), F.lit("m").alias("message"))), F.lit("\n"))
    x = t(spark, d, "conversations").select("conv_id", "turn", frame.alias("frame"))
    lines = x.select("conv_id", "turn", F.explode(F.split("frame", "\n")).alias("value"))
    return readers.parse_events(lines, keep=["conv_id", "turn"]).select("conv_id", "turn", "stage", "percent", "terminal")


@query(X + " SELECT id FROM x WHERE kind IN (5, 6, 7, 8, 11) OR n % 4 = 0")
def a22_chapter_names(spark, d):
    x = rows(spark, d, "part", TENDER).withColumn("style", F.when(F.col("n") % 4 == 0, "Heading 1").otherwise("Normal"))
    return x.where(docx.chapter_name(F.col("text"), F.col("style"))).select("id")


@query(f"WITH {LINES} SELECT doc_id, CAST(page_idx * 20 AS INTEGER) AS start, substr(string_agg(text, chr(10) ORDER BY block_idx), 1, 20000) AS text FROM blocks WHERE text <> '' GROUP BY doc_id, page_idx")
def a24_section_texts(spark, d):
    b = chapters.blocks(t(spark, d, "documents"))
    pages = b.groupBy("doc_id", "page_idx").agg(F.min("block_idx").alias("block_idx"), (F.max("block_idx") + 1).alias("end_idx"))
    return chapters.section_text(b, pages).select("doc_id", "start", "text")


@query(f"WITH {LINES} SELECT doc_id, CAST(page_idx AS INTEGER) AS page_idx, count(*) FILTER (NOT contains(text, '|')) AS paragraphs, count(*) FILTER (contains(text, '|')) AS tables, 0 AS images, count(*) FILTER (text = '') AS empty FROM blocks GROUP BY doc_id, page_idx")
def a25_section_counters(spark, d):
    b = chapters.blocks(t(spark, d, "documents")).withColumn("type", F.when(F.contains("text", F.lit("|")), "table").otherwise("text"))
    return sections.block_counters(b, ["doc_id", "page_idx"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
def b3_point_lookup(spark, d):
    x = t(spark, d, "nation")
    region = x.where("n_nationkey = 3").first()["n_regionkey"]
    return relational.one(x, n_nationkey=3, n_regionkey=region).select("n_nationkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%1%' AND c_mktsegment = 'BUILDING'")
def b5_template_filters(spark, d):
    return relational.matching(t(spark, d, "customer"), {"c_name": "1"}, {"c_mktsegment": ("BUILDING", {"BUILDING"}), "c_phone": ("x", {"y"})}).select("c_custkey")


@query("SELECT n_name AS value FROM nation WHERE n_nationkey = 5")
def b6_setting(spark, d):
    kv = t(spark, d, "nation").select(F.when(F.col("n_regionkey") == 0, "system").otherwise("enterprise").alias("scope"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).alias("tenant"), F.concat(F.lit("k"), "n_nationkey").alias("key"), F.col("n_name").alias("value"), "n_nationkey", "n_regionkey")
    region = kv.where("n_nationkey = 5").first()["n_regionkey"]
    return relational.setting(kv, "enterprise" if region else "system", str(region) if region else None, "k5").select("value")


BIN = "b AS (SELECT o_orderkey AS ref_id, CASE o_orderkey % 3 WHEN 0 THEN 'material' WHEN 1 THEN 'template' ELSE 'enterprise' END AS item_type, CAST(o_custkey % 5 AS VARCHAR) AS tenant, CASE o_orderkey % 11 WHEN 0 THEN 'conflict' WHEN 1 THEN 'restoring' ELSE 'ok' END AS status, o_orderdate AS deleted_at, o_orderdate + INTERVAL 30 DAY AS purge_at FROM orders)"


def bin_table(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(k.alias("ref_id"), F.element_at(F.array(F.lit("material"), F.lit("template"), F.lit("enterprise")), (k % 3 + 1).cast("int")).alias("item_type"), (F.col("o_custkey") % 5).cast("string").alias("tenant"), F.when(k % 11 == 0, "conflict").when(k % 11 == 1, "restoring").otherwise("ok").alias("status"), F.col("o_orderdate").alias("deleted_at"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("purge_at"))


@query(f"WITH {BIN} SELECT ref_id, 'own' AS list FROM b WHERE tenant = '2' AND item_type = 'material' UNION ALL SELECT ref_id, 'all' FROM b WHERE item_type = 'enterprise'")
def b7_recycle_lists(spark, d):
    b = bin_table(spark, d)
    own, every = relational.bin_rows(b, "2", "material"), relational.bin_rows(b, None, "material")
    return own.select("ref_id", F.lit("own").alias("list")).unionByName(every.select("ref_id", F.lit("all").alias("list")))


ROUNDS = "r AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'selected' WHEN 'O' THEN 'pending' ELSE 'missing' END AS status, CAST(1 + o_orderkey % 3 AS BIGINT) AS round FROM orders), last AS (SELECT r.* FROM r WHERE round = (SELECT max(round) FROM r q WHERE q.owner = r.owner))"


def rounds(spark, d):
    return orders(spark, d).select("id", "owner", "status", (1 + F.col("id") % 3).alias("round"))


@query(f"WITH {ROUNDS} SELECT id, owner, round FROM last WHERE status = 'pending'")
def b9_latest_round(spark, d):
    return relational.latest_round(rounds(spark, d), "owner", pending=True).select("id", "owner", "round")


@query(f"WITH {ROUNDS} SELECT id, owner, 'pending' AS status, round + 1 AS round FROM last")
def j7_next_round(spark, d):
    return relational.next_round(rounds(spark, d), "owner", reset_status=True).select("id", "owner", "status", "round")


@query(f"WITH {ROUNDS} SELECT owner, count(*) AS items, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'pending') = 0 AS ok FROM last GROUP BY owner")
def j8_round_gate(spark, d):
    return relational.round_gate(relational.latest_round(rounds(spark, d), "owner"), "owner")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey <> 3")
def b14_stray_rows(spark, d):
    return relational.strays(t(spark, d, "customer"), c_mktsegment="BUILDING", c_nationkey=3).select("c_custkey")


@query("SELECT c_custkey AS id, u.level, CASE u.level WHEN 'public' THEN true WHEN 'enterprise' THEN c_nationkey % 2 = 0 WHEN 'project' THEN c_nationkey % 2 = 0 AND c_nationkey % 3 = 0 WHEN 'material' THEN c_nationkey % 2 = 0 AND c_nationkey % 3 = 0 AND c_acctbal > 0 ELSE false END AS open FROM customer, (VALUES ('public'), ('enterprise'), ('project'), ('material'), ('none')) u(level)")
def b17_access(spark, d):
    n = F.col("c_nationkey")
    x = t(spark, d, "customer").select("*", F.explode(F.array(*[F.lit(k) for k in ("public", "enterprise", "project", "material", "none")])).alias("level"))
    flags = {"enterprise": n % 2 == 0, "project": n % 3 == 0, "parse": n > 0, "format": n > 1, "material": F.col("c_acctbal") > 0}
    return x.select(F.col("c_custkey").alias("id"), "level", workflow.access(F.col("level"), flags).alias("open"))


STATES = ("INIT", "UPLOADED", "PARSING", "PARSED", "SCORE_PARSED", "PARSE_REVIEW")
EDGES = ", ".join(f"('{a}', '{b}')" for a, to in workflow.TRANSITIONS.items() for b in to)
MOVES = f"e(a, b) AS (VALUES {EDGES}), s AS (SELECT event_id, user_id, ts, [{', '.join(repr(x) for x in STATES)}][event_id % 6 + 1] AS from_state, [{', '.join(repr(x) for x in STATES)}][CAST(user_id + event_id AS BIGINT) % 6 + 1] AS to_state FROM events)"


def moves(spark, d, events=None):
    at = lambda c: F.element_at(F.array(*[F.lit(x) for x in STATES]), (c % 6 + 1).cast("int"))
    return (t(spark, d, "events") if events is None else events).select("event_id", "user_id", "ts", at(F.col("event_id")).alias("from_state"), at(F.col("user_id") + F.col("event_id")).alias("to_state"))


@query(f"WITH {MOVES} SELECT event_id, EXISTS (SELECT 1 FROM e WHERE e.a = from_state AND e.b = to_state) AS legal FROM s")
def b18_legal_moves(spark, d):
    return workflow.legal(moves(spark, d), workflow.edges(spark)).select("event_id", "legal")


@query(f"WITH RECURSIVE {MOVES}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM s), w AS (SELECT user_id, i, event_id, 'INIT' AS from_state, to_state, EXISTS (SELECT 1 FROM e WHERE e.a = 'INIT' AND e.b = to_state) AS legal FROM q WHERE i = 1 UNION ALL SELECT q.user_id, q.i, q.event_id, CASE WHEN w.legal THEN w.to_state ELSE w.from_state END, q.to_state, EXISTS (SELECT 1 FROM e WHERE e.a = CASE WHEN w.legal THEN w.to_state ELSE w.from_state END AND e.b = q.to_state) FROM w JOIN q ON q.user_id = w.user_id AND q.i = w.i + 1) SELECT event_id, user_id, from_state, to_state, legal FROM w")
def k1_audited_moves(spark, d):
    return workflow.audited(moves(spark, d).select("user_id", "ts", "event_id", "to_state"), workflow.TRANSITIONS, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "from_state", "to_state", "legal")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n FROM blocks WHERE page_idx < 3 GROUP BY doc_id")
def b19_first_pages(spark, d):
    return chapters.blocks(t(spark, d, "documents")).where("page_idx < 3").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') AS deletable FROM customer")
def b20_delete_guard(spark, d):
    live = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return relational.deletable(t(spark, d, "customer"), live, "c_custkey").select("c_custkey", "deletable")


@query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 2000")
def b21_size_limit(spark, d):
    return t(spark, d, "documents").where(F.octet_length("text") <= 2000).select("doc_id")


@query("SELECT p_partkey FROM part WHERE lower(replace(p_name, ' ', '')) = (SELECT lower(replace(p_name, ' ', '')) FROM part WHERE p_partkey = 7)")
def b22_by_chapter(spark, d):
    x = t(spark, d, "part").withColumn("key", T.chapter_key(F.col("p_name")))
    return x.join(x.where("p_partkey = 7").select("key"), "key", "left_semi").select("p_partkey")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) ELSE concat('【缺失：c', o_custkey, '】') END AS shown FROM orders GROUP BY o_custkey")
def b23_display_values(spark, d):
    x = templates.decided(t(spark, d, "orders"), "o_custkey", "o_orderpriority", ["o_orderkey"])
    return x.select("o_custkey", templates.display(F.col("value"), F.col("needs_manual"), F.concat(F.lit("c"), "o_custkey")).alias("shown"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def c2_config_join(spark, d):
    return t(spark, d, "orders").where("o_totalprice > 100000").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def c3_foreign_rows(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("SELECT p_partkey AS id, CAST(-1 * p_size AS DOUBLE) AS rank FROM part WHERE contains(lower(p_name), 'ar') AND p_size % 7 <> 0 AND (p_size % 2 = 0 OR p_partkey % 10 = 4)")
def c4_candidates(spark, d):
    x = t(spark, d, "part")
    hits = x.where(F.contains(F.lower("p_name"), F.lit("ar"))).select(F.col("p_partkey").alias("id"), (-1.0 * F.col("p_size")).alias("rank"))
    mat = x.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 != 0, F.col("p_partkey") % 10).alias("project_id"), F.when(F.col("p_size") % 7 == 0, F.lit("2000-01-01").cast("timestamp")).alias("deleted_at"))
    return search.candidates(hits, mat, 4).select("id", "rank")


@query(f"WITH {O} SELECT id, CASE WHEN status = 'selected' THEN (SELECT p_name FROM part WHERE p_partkey = o.owner) END AS material, coalesce(status = 'selected' AND EXISTS (SELECT 1 FROM part WHERE p_partkey = o.owner), false) AS found FROM o")
def c5_selected_materials(spark, d):
    mat = t(spark, d, "part").select(F.col("p_partkey").alias("owner"), F.col("p_name").alias("material"))
    x = orders(spark, d).withColumn("owner", F.when(F.col("status") == "selected", F.col("owner"))).join(mat, "owner", "left")
    return x.select("id", "material", F.col("material").isNotNull().alias("found"))


ASSOC = "a AS (SELECT l_orderkey AS k, l_linenumber AS pos, min(CAST(l_quantity AS BIGINT)) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL), b AS (SELECT l_orderkey AS k, l_linenumber AS pos, min(CAST(l_quantity AS BIGINT)) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)"


def association(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "N").alias("own")).agg(F.concat(F.lit("N "), F.min(F.col("l_quantity").cast("long"))).alias("name"))
    return x.where("own").select("k", "pos", "name"), x.where("not own").select("k", "pos", "name")


@query(f"WITH {ASSOC} SELECT k, pos, concat('N ', coalesce((SELECT v FROM b WHERE b.k = a.k AND b.v = a.v LIMIT 1), (SELECT v FROM b WHERE b.k = a.k AND b.pos = a.pos))) AS template, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.v = a.v) THEN 'name' WHEN EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.pos = a.pos) THEN 'place' ELSE 'none' END AS how FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND (b.v = a.v OR b.pos = a.pos))")
def c6_associations(spark, d):
    return templates.associated(*association(spark, d), "k").where("how <> 'none'").select("k", "pos", "template", "how")


@query(f"WITH {ASSOC}, u AS (SELECT k, pos, coalesce((SELECT v FROM b WHERE b.k = a.k AND b.v = a.v LIMIT 1), (SELECT v FROM b WHERE b.k = a.k AND b.pos = a.pos)) AS v FROM a) SELECT k, pos FROM b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.k = b.k AND u.v = b.v)")
def c7_unused_templates(spark, d):
    parse, template = association(spark, d)
    used = templates.associated(parse, template, "k").select("k", F.col("template").alias("name")).where("name is not null").distinct()
    return template.join(used, ["k", "name"], "left_anti").select("k", "pos")


@query("WITH h AS (SELECT doc_id, unnest(range(3)) AS pos FROM documents) SELECT doc_id AS source, pos, CASE pos WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 END AS block_idx FROM h WHERE NOT (pos = 1 AND doc_id % 2 = 0)")
def c8_located_headings(spark, d):
    """Blocks A B A A C of page 0, with the second A on another page in even sources: headings A, A, C in order."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("source"))
    even = F.col("source") % 2 == 0
    texts = F.array(*[F.struct(F.lit(k).alias("block_idx"), x.alias("text"), p.alias("page_idx")) for k, (x, p) in enumerate([(F.lit("序"), F.lit(0)), (F.lit("甲 章"), F.lit(0)), (F.lit("乙"), F.lit(0)), (F.lit("丙"), F.lit(0)), (F.lit("甲章"), F.when(even, 1).otherwise(0)), (F.lit("丁"), F.lit(0))])])
    blocks = docs.select("source", F.inline(texts))
    heads = docs.select("source", F.posexplode(F.array(F.lit("甲章"), F.lit("甲章"), F.lit("丁"))).alias("pos", "text")).withColumn("page_idx", F.lit(0))
    return sections.located(heads, blocks)


@query("SELECT doc_id AS source, 4 AS toc_count, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 3 END AS matched FROM documents")
def c9_crosschecked_toc(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("source"))
    lines = lambda *names: docs.select("source", F.posexplode(F.array(*names)).alias("pos", "title"))
    toc = lines(F.lit("第一章 总则要求"), F.lit("附件"), F.when(F.col("source") % 3 == 0, "别处标题").otherwise("投标文件格式"), F.lit("合同"))
    body = lines(F.lit("总则"), F.lit("第一章 总则要求说明"), F.lit("投标文件 格式（一）"), F.lit("合同"))
    return sections.crosschecked(toc, body)


PACK = [("bond", "contains", "保证金"), ("format", "contains", "投标文件格式"), ("tech", "exact", "技术方案"), ("tech", "contains", "方案"), ("score", "contains", "分")]


@query(X + " SELECT id, u.rule FROM x, (VALUES ('bond', '保证金'), ('format', '投标文件格式'), ('tech', '方案'), ('score', '分')) u(rule, word) WHERE contains(replace(text, ' ', ''), u.word)")
def c10_keyword_hits(spark, d):
    pack = spark.createDataFrame([p for p in PACK if p[1] == "contains"], "rule string, kind string, keyword string")
    x = rows(spark, d, "part", TENDER).select(F.col("doc").alias("source"), F.col("id").alias("node_id"), F.col("text").alias("title"), "id")
    return rules.keyword_hits(x, pack).select("id", "rule")


@query(X + " SELECT id FROM x WHERE kind IN (5, 6, 7, 9, 11) AND (kind NOT IN (6, 7) OR NOT EXISTS (SELECT 1 FROM x y WHERE y.doc = x.doc AND y.kind = 5)) AND (kind <> 11 OR NOT EXISTS (SELECT 1 FROM x y WHERE y.doc = x.doc AND y.kind = 9))")
def c11_outermost_hits(spark, d):
    """Lines with scores below a category line that is a hit itself are left out."""
    x = rows(spark, d, "part", TENDER)
    up = F.when(F.col("kind").isin(6, 7), F.array(F.concat("doc", F.lit("-5")))).when(F.col("kind") == 11, F.array(F.concat("doc", F.lit("-9")))).otherwise(F.array().cast("array<string>"))
    nodes = x.select(F.col("doc").alias("source"), F.concat("doc", F.lit("-"), "kind").alias("node_id"), F.col("text").alias("title"), up.alias("ancestors"), "id")
    pack = spark.createDataFrame([("score", "contains", "分")], "rule string, kind string, keyword string")
    return rules.outermost(rules.keyword_hits(nodes, pack)).select("id")


SAME_FILES = "WITH f AS (SELECT doc_id, doc_id // 3 AS g, doc_id % 3 AS k, CASE WHEN doc_id % 2 = 0 THEN lang ELSE text END AS x FROM documents) SELECT a.doc_id AS first, b.doc_id AS other FROM f a JOIN f b ON a.g = b.g AND a.k < b.k WHERE regexp_replace(a.x, '[ \\t\\n\\r]', '', 'g') = regexp_replace(b.x, '[ \\t\\n\\r]', '', 'g')"


@query(SAME_FILES)
def c12_equal_files(spark, d):
    """Files of a name group whose contents agree by digest; the ratio of others has no SQL and is left out by its bound."""
    x = t(spark, d, "documents").select("doc_id", F.expr("doc_id div 3").alias("g"), (F.col("doc_id") % 3).alias("k"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.col("text")).alias("x"))
    # Before the join, each text once, and whole: what is equal is told by digests, an empty one's stays empty.
    x = x.withColumn("x", files.compared(F.col("x"))).withColumn("x", F.when(F.col("x") == "", "").otherwise(F.sha2("x", 256)))
    one = x.select("g", F.col("k").alias("a_k"), F.col("doc_id").alias("first"), F.col("x").alias("a_text"), F.lit(1).alias("a_pages"))
    two = x.select("g", F.col("k").alias("b_k"), F.col("doc_id").alias("other"), F.col("x").alias("b_text"), F.lit(1).alias("b_pages"))
    return files.same_content(one.join(two, "g").where("a_k < b_k"), least=1.1, shortened=True).where("same").select("first", "other")


@query("SELECT o_custkey, count(*) AS files, bool_and(o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey")
def c13_manifest(spark, d):
    state = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    x = t(spark, d, "orders").select("o_custkey", "o_orderkey").join(state, "o_orderkey", "left")
    return x.groupBy("o_custkey").agg(F.count("*").alias("files"), F.bool_and(F.coalesce(F.col("state") == "F", F.lit(False))).alias("done"))


@query("SELECT l_orderkey AS project, l_partkey AS chapter, l_linenumber AS idx, CASE WHEN l_partkey % 3 = 0 THEN l_partkey ELSE l_linenumber END AS seq, CASE WHEN l_suppkey % 2 = 0 THEN 'v' END AS value FROM lineitem")
def c16_render_plan(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("project"), F.col("l_partkey").alias("chapter"), F.col("l_linenumber").cast("long").alias("idx"), F.concat_ws("-", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("name"), "l_suppkey")
    order = x.where("chapter % 3 = 0").select("project", "chapter", F.col("chapter").alias("seq")).distinct()
    before = x.where("l_suppkey % 2 = 0").select("project", "chapter", "name", F.lit("v").alias("value"), F.lit(False).alias("manual")).distinct()
    found = templates.render_plan(x.drop("l_suppkey"), order, before)
    return found.select("project", "chapter", F.split("name", "-")[0].cast("int").alias("idx"), "seq", "value")


@query("SELECT c_custkey AS key, u.name, CASE WHEN u.name = 'agent' AND c_acctbal > 5000 THEN 'confirmed' WHEN u.name = 'segment' THEN c_mktsegment ELSE c_name END AS value, CASE WHEN u.name = 'agent' AND c_acctbal > 5000 THEN 'confirmed' WHEN u.name = 'segment' THEN 'project' ELSE 'enterprise' END AS source FROM customer, (VALUES ('agent'), ('segment')) u(name)")
def c18_context(spark, d):
    x = t(spark, d, "customer")
    row = lambda df, name, value: df.select(F.col("c_custkey").alias("key"), F.lit(name).alias("name"), value.alias("value"))
    firm = row(x, "agent", F.col("c_name")).unionByName(row(x, "segment", F.col("c_name")))
    return templates.context((firm, "enterprise"), (row(x, "segment", F.col("c_mktsegment")), "project"), (row(x.where("c_acctbal > 5000"), "agent", F.lit("confirmed")), "confirmed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY")
def c19_changed_since(spark, d):
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return t(spark, d, "lineitem").join(t(spark, d, "orders"), on).select("l_orderkey", "l_linenumber", "l_partkey")


@query("WITH x AS (SELECT c_nationkey AS key, c_name AS path, 0 AS source FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier) SELECT key, arg_min(path, source * 1000 || path) AS path, min(source) AS source FROM x GROUP BY key")
def c22_first_directory(spark, d):
    one = t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("path"))
    return relational.first_source("key", one, t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("path")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('01_c', p_partkey) WHEN p_partkey % 3 = 0 THEN concat('c', p_partkey) END AS path FROM part")
def c23_chapter_files(spark, d):
    x = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("c"), "p_partkey").alias("key"))
    numbered = x.where("id % 2 = 0").select("key", F.concat(F.lit("01_"), "key").alias("path"))
    exact = x.where("id % 2 = 0 or id % 3 = 0").select("key", F.col("key").alias("path"))
    return x.join(relational.first_source("key", numbered, exact), "key", "left").select("id", "path")
