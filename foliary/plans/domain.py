"""Registered queries that run the document operators on tender text made of the driver's tables, each with its SQL twin.

A relation is a list of column expressions that both engines read alike, so a query and its twin start from the same
rows; what the operator then computes, the twin computes in its own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions import naming
from foliary.functions import text as T
from foliary.operators import files, rules, sections, templates
from foliary.plans.catalog import query, t

LINES = {
    0: "concat('监理大纲页数不超过', p_size, '页')",
    1: "concat('投标保证金金额', p_size, '万元')",
    2: "concat('服务期限', p_size, '个月')",
    3: "concat('近', p_size % 12 + 1, '个月的社保证明')",
    4: "concat('正本', p_size % 9 + 1, '份，副本 ', p_size, ' 份')",
    5: "concat('一、商务评分（满分', p_size, '分）')",
    6: "concat('1. 企业业绩 ', p_size, '分，提供合同、中标通知书；样品')",
    7: "concat('2. 人员 每项5分，满分', p_size, '分，至少', p_size % 5 + 1, '项（职称证、其他）')",
    8: "concat('第', p_size, '章 投标文件格式')",
    9: "concat('技术方案 ', p_size, '分')",
    10: "concat('单项合同额不低于', p_size, '万元，有效期至2025年', p_size % 12 + 1, '月5日')",
    11: "concat('3. 信誉 ', p_size, '分，供应商应具备良好的商业信誉和健全的财务会计制度')",
}
TENDER = ("p_partkey AS id", "cast(floor(p_partkey / 12) AS bigint) AS doc", "cast(p_partkey % 12 AS int) AS kind", "CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN {v}" for k, v in LINES.items()) + " END AS text", "p_size AS n")


def rows(spark: SparkSession, d: str, table: str, columns: tuple[str, ...]) -> DataFrame:
    return t(spark, d, table).selectExpr(*columns)


def sql(table: str, columns: tuple[str, ...]) -> str:
    return f"SELECT {', '.join(columns)} FROM {table}"


X = f"WITH x AS ({sql('part', TENDER)})"


@query(X + ", c AS (SELECT id, unnest(CASE kind WHEN 0 THEN [{'k': 'page_limit', 'v': concat(n, '页')}] WHEN 1 THEN [{'k': 'amount', 'v': concat(n, '万元')}] WHEN 2 THEN [{'k': 'period', 'v': concat(n, '月')}] WHEN 3 THEN [{'k': 'period', 'v': concat(n % 12 + 1, '月')}, {'k': 'social_security', 'v': concat(n % 12 + 1, '个月')}] WHEN 4 THEN [{'k': 'quantity', 'v': concat('正本', n % 9 + 1, '份')}, {'k': 'quantity', 'v': concat('副本 ', n, ' 份')}] WHEN 10 THEN [{'k': 'amount', 'v': concat(n, '万元')}, {'k': 'period', 'v': '2025年'}, {'k': 'period', 'v': concat(n % 12 + 1, '月')}, {'k': 'period', 'v': '5日'}] ELSE [] END) AS c FROM x) SELECT id, c.k AS kind, c.v AS value FROM c")
def h5_constraints(spark, d):
    return rules.constraint_rows(rows(spark, d, "part", TENDER), ["id"]).select("id", "kind", "value")


@query(X + ", c AS (SELECT id, unnest(CASE kind WHEN 1 THEN [{'k': 'amount', 'v': concat(n, '万元')}] WHEN 7 THEN [{'k': 'quantity', 'v': concat(n % 5 + 1, '项')}] WHEN 10 THEN [{'k': 'date', 'v': concat('2025-', lpad(CAST(n % 12 + 1 AS VARCHAR), 2, '0'), '-05')}, {'k': 'amount', 'v': concat(n, '万元')}] ELSE [] END) AS c FROM x) SELECT id, c.k AS kind, c.v AS value FROM c")
def h6_thresholds(spark, d):
    return rows(spark, d, "part", TENDER).select("id", F.inline(T.thresholds(F.col("text"))))


@query(X + " SELECT id, kind = 5 OR kind = 9 AS category, CASE kind WHEN 5 THEN '商务评分' WHEN 9 THEN '技术方案' END AS name FROM x")
def h7_category_lines(spark, d):
    open_ = rules.category_line(F.col("text"))
    return rows(spark, d, "part", TENDER).select("id", open_.alias("category"), F.when(open_, rules.category_name(F.col("text"))).alias("name"))


SCORED = X + ", s AS (SELECT doc, id, kind, n, CASE kind WHEN 6 THEN '企业业绩 ，提供合同、中标通知书；样品' WHEN 7 THEN concat('人员 ，，至少', n % 5 + 1, '项（职称证、其他') WHEN 11 THEN '信誉 ，供应商应具备良好的商业信誉和健全的财务会计制度' END AS name, CASE WHEN kind > 9 THEN '技术方案' WHEN kind > 5 AND EXISTS (SELECT 1 FROM x y WHERE y.doc = x.doc AND y.kind = 5) THEN '商务评分' END AS category FROM x WHERE kind IN (6, 7, 11)), i AS (SELECT doc, id, coalesce(category, CASE WHEN NOT EXISTS (SELECT 1 FROM x y WHERE y.doc = s.doc AND y.kind IN (5, 9)) THEN '未分类' END) AS category, name, CAST(n AS DOUBLE) AS score, kind FROM s)"


@query(SCORED + " SELECT doc, id, category, name, score, kind <> 7 AS unrecognized FROM i WHERE category IS NOT NULL")
def h9_score_items(spark, d):
    found = rules.score_items(rows(spark, d, "part", TENDER), "doc", "id")
    return found.select("doc", "id", "category", "name", "score", (F.col("unrecognized") != "").alias("unrecognized"))


@query(X + " SELECT id, CASE kind WHEN 6 THEN '合同|中标通知书' WHEN 7 THEN '职称证' ELSE '' END AS materials FROM x")
def h10_materials(spark, d):
    return rows(spark, d, "part", TENDER).select("id", F.array_join(rules.materials(F.col("text")), "|").alias("materials"))


@query(SCORED + " SELECT doc, count(DISTINCT category) AS categories, sum(score) AS total, abs(sum(score) - 100) < 0.01 AS is_100 FROM i WHERE category IS NOT NULL GROUP BY doc")
def d8_score_totals(spark, d):
    return rules.totals(rules.score_items(rows(spark, d, "part", TENDER), "doc", "id"), "doc")


@query(X + " SELECT id, CASE kind WHEN 0 THEN 'tech' WHEN 9 THEN 'tech' WHEN 6 THEN 'business' ELSE 'general' END AS nature, kind = 1 AND contains(text, '报价表') AS external, CASE kind % 4 WHEN 0 THEN '投标人' WHEN 1 THEN '供应商' WHEN 2 THEN '供应商' ELSE '投标人' END AS word FROM x")
def h11_nature_and_terms(spark, d):
    kinds = F.element_at(F.array(F.lit("招标"), F.lit("采购"), F.lit("询比价"), F.lit("未知")), F.col("kind") % 4 + 1)
    return rows(spark, d, "part", TENDER).select("id", T.nature(F.col("text")).alias("nature"), T.external(F.col("text")).alias("external"), T.term(kinds, F.lit("主体")).alias("word"))


@query(X + " SELECT id, substr(text, strpos(text, '满分'), 22) AS snippet FROM x WHERE contains(text, '满分')")
def h23_snippets(spark, d):
    return rows(spark, d, "part", TENDER).select("id", T.snippet_after(F.col("text"), "满分").alias("snippet")).where("snippet is not null")


@query(X + " SELECT id, array_to_string(list_distinct(regexp_extract_all(text, '[一-龥]{4,}')), '|') AS words FROM x WHERE kind IN (0, 1, 2, 8)")
def h24_cjk_words(spark, d):
    return rows(spark, d, "part", TENDER).where("kind in (0, 1, 2, 8)").select("id", F.array_join(T.cjk_words(F.col("text"), 4), "|").alias("words"))


@query(X + " SELECT id, CASE kind WHEN 8 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 3 WHEN 11 THEN 3 END AS level, CASE kind WHEN 8 THEN concat('第', n, '章') WHEN 5 THEN '一、' WHEN 6 THEN '1.' WHEN 7 THEN '2.' WHEN 11 THEN '3.' END AS number FROM x WHERE kind IN (5, 6, 7, 8, 11)")
def h3_headings(spark, d):
    return rows(spark, d, "part", TENDER).select("id", T.heading(F.col("text")).alias("h")).where("h is not null").select("id", "h.level", "h.number")


@query(X + " SELECT id, CASE WHEN kind = 8 THEN 1 WHEN kind IN (6, 7, 11) THEN CASE n % 6 WHEN 1 THEN 1 ELSE 3 END WHEN kind = 5 THEN CASE n % 6 WHEN 1 THEN 1 ELSE 2 END ELSE least(greatest(n % 6, 1), 4) END AS level FROM x")
def h4_reconciled_levels(spark, d):
    return rows(spark, d, "part", TENDER).select("id", T.heading_level((F.col("n") % 6).cast("int"), T.heading(F.col("text"))["level"]).cast("int").alias("level"))


@query(X + ", y AS (SELECT id, concat(text, CASE n % 5 WHEN 0 THEN '√' WHEN 1 THEN '：' WHEN 2 THEN '' WHEN 3 THEN '；' ELSE '5%' END) AS s, n FROM x) SELECT id, n % 5 IN (0, 1, 3) OR (n % 5 = 4 AND length(s) <= 12) OR (n % 5 = 2 AND regexp_matches(s, '[：:、，,。；！？）)]$')) AS noise FROM y")
def b13_body_noise(spark, d):
    ends = F.element_at(F.array(*[F.lit(x) for x in ("√", "：", "", "；", "5%")]), F.col("n") % 5 + 1)
    return rows(spark, d, "part", TENDER).select("id", T.body_noise(F.concat("text", ends)).alias("noise"))


@query(X + ", y AS (SELECT doc, id, concat(text, '......', n) AS s FROM x UNION ALL SELECT doc, id, text FROM x) SELECT doc, count(*) AS n FROM y WHERE regexp_matches(s, '\\.{2,}[ ]*[0-9]+$') GROUP BY doc")
def b12_toc_lines(spark, d):
    x = rows(spark, d, "part", TENDER)
    lines = x.select("doc", F.concat("text", F.lit("......"), "n").alias("s")).unionByName(x.select("doc", F.col("text").alias("s")))
    return lines.where(T.toc_line(F.col("s"))).groupBy("doc").agg(F.count("*").alias("n"))


@query(X + ", y AS (SELECT doc, count(*) FILTER (kind IN (6, 8)) AS a, count(*) FILTER (kind = 11) AS b FROM x GROUP BY doc) SELECT doc, CASE WHEN a = 0 AND b = 0 THEN '未知' WHEN a >= b THEN '招标' ELSE '采购' END AS type FROM y")
def d9_document_types(spark, d):
    texts = rows(spark, d, "part", TENDER).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return texts.select("doc", T.doc_type(F.col("text")).alias("type"))


NAMES = ("p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN 'qualification' WHEN 1 THEN 'performance' WHEN 2 THEN 'honor' WHEN 3 THEN 'finance' ELSE 'other' END AS category", "CASE p_partkey % 5 WHEN 0 THEN '注册证书' WHEN 1 THEN '监理合同' WHEN 3 THEN '审计报告' END AS type", "p_name AS name", "p_size % 3 AS page", "CASE WHEN p_size % 2 = 0 THEN '2025-03-07' END AS day")
NAMED = f"WITH x AS ({sql('part', NAMES)}), y AS (SELECT *, substr(replace(name, ' ', ''), 1, 30) AS s, CASE WHEN day IS NULL THEN 'changqi' ELSE '20250307' END AS e, CASE WHEN page > 0 THEN concat('_P', page) ELSE '' END AS p FROM x), f AS (SELECT id, category, type, page, day, s, e, concat(CASE category WHEN 'qualification' THEN concat('zcs_', s, '_', e) WHEN 'performance' THEN concat('jlst_', s, '_', e) WHEN 'honor' THEN concat('ry_', s, '_2024') WHEN 'finance' THEN 'smbg_2024' ELSE s END, p) AS file FROM y)"


def named(spark, d):
    x = rows(spark, d, "part", NAMES)
    fields = {"cert_type": F.col("type"), "perf_type": F.col("type"), "fin_type": F.col("type"), "person": F.col("name"), "project": F.col("name"), "honor": F.col("name"), "valid_until": F.col("day"), "contract_date": F.col("day"), "year": F.lit("2024年")}
    return x.withColumn("file", naming.file_name(F.col("category"), F.col("name"), fields, F.col("page")))


@query(NAMED + " SELECT id, file FROM f")
def h14_material_names(spark, d):
    return named(spark, d).select("id", "file")


@query(NAMED + " SELECT id, CASE WHEN page > 0 THEN page END AS page, CASE WHEN category IN ('qualification', 'performance') AND day IS NOT NULL THEN DATE '2025-03-07' END AS valid_until, CASE category WHEN 'qualification' THEN 'cert_type' WHEN 'performance' THEN 'perf_type' WHEN 'finance' THEN 'fin_type' WHEN 'honor' THEN 'cert_type' END AS kind, CASE category WHEN 'honor' THEN '个人荣誉' ELSE type END AS type, CASE category WHEN 'qualification' THEN concat(s, '_', e) WHEN 'performance' THEN concat(s, '_', e) WHEN 'honor' THEN concat(s, '_2024') WHEN 'finance' THEN '2024' END AS rest FROM f")
def h15_parsed_names(spark, d):
    return named(spark, d).select("id", naming.parsed_name(F.col("file")).alias("p")).select("id", "p.*")


@query("SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 7 = 0 THEN '_con.' ELSE '' END, replace(p_name, ' ', '_')) AS name FROM part")
def h16_safe_names(spark, d):
    raw = F.concat(F.when(F.col("p_partkey") % 7 == 0, "con.").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("?")), F.lit(" . "))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.safe_name(raw).alias("name"))


TEMPLATE = ("p_partkey AS id", "concat('{% if a %}{{ enterprise_name }}', CASE WHEN p_size % 2 = 0 THEN '{% endif %}' ELSE '' END, '{{img_seal}}{{ personnel_name }}{{enterprise_name}}', CASE WHEN p_size % 3 = 0 THEN '{{ 1bad }}' ELSE '' END) AS text", "p_size AS n")


@query(f"WITH x AS ({sql('part', TEMPLATE)}) SELECT id, u.name, u.class FROM x, (VALUES ('enterprise_name', 'a_class'), ('img_seal', 'image'), ('personnel_name', 'b_class')) u(name, class)")
def h20_placeholders(spark, d):
    found = rows(spark, d, "part", TEMPLATE).select("id", F.explode(T.placeholders(F.col("text"))).alias("name"))
    return found.select("id", "name", T.placeholder_class(F.col("name"), list(templates.VALUE_RULES)).alias("class"))


@query(f"WITH x AS ({sql('part', TEMPLATE)}) SELECT id, concat_ws(',', CASE WHEN n % 2 = 1 THEN 'if' END, CASE WHEN n % 3 = 0 THEN 'name' END) AS issues, n % 2 = 0 AND n % 3 <> 0 AS ok FROM x")
def h21_template_syntax(spark, d):
    return templates.compliance(rows(spark, d, "part", TEMPLATE), "id").select("id", F.array_join("issues", ",").alias("issues"), "ok")


@query(f"WITH x AS ({sql('part', TEMPLATE)}) SELECT id, u.name FROM x, (VALUES ('img_seal'), ('personnel_name')) u(name)")
def c17_uncovered_names(spark, d):
    return templates.coverage(rows(spark, d, "part", TEMPLATE), spark.createDataFrame([("enterprise_name",)], "name string"), "id")


@query(f"WITH x AS ({sql('part', TEMPLATE)}) SELECT u.issue, count(*) AS files FROM x, (VALUES ('if'), ('name')) u(issue) WHERE (u.issue = 'if' AND n % 2 = 1) OR (u.issue = 'name' AND n % 3 = 0) GROUP BY u.issue")
def d28_compliance_counts(spark, d):
    return templates.compliance(rows(spark, d, "part", TEMPLATE), "id").select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("files"))


OCR = ("c_custkey AS id", "concat('姓 名：', c_name, chr(10), '合同金额：', cast(c_nationkey AS string), '万元', chr(10), '证书编号: A', c_custkey, chr(10), '有效期至 2026年', c_nationkey % 12 + 1, '月1日') AS text", "c_nationkey AS n", "c_name AS name")


@query(f"WITH x AS ({sql('customer', OCR)}), y AS (SELECT id, unnest([{{'f': 'personnel_name', 'v': name}}, {{'f': 'performance_contract_amount', 'v': concat(n, '万元')}}, {{'f': 'personnel_cert_number', 'v': concat('A', id)}}, {{'f': 'qualification_cert_number', 'v': concat('A', id)}}, {{'f': 'qualification_valid_until', 'v': concat('2026年', n % 12 + 1, '月1')}}]) AS u FROM x) SELECT id, u.f AS field, 0 AS pos, u.v AS value FROM y")
def h22_field_values(spark, d):
    return templates.values(rows(spark, d, "customer", OCR), "id")


@query("WITH x AS (SELECT o_custkey AS project, o_orderkey AS id, o_orderkey % 3 AS v FROM orders WHERE o_orderkey % 2 = 0) SELECT project, count(DISTINCT v) AS n_values, count(*) AS n_chapters FROM x GROUP BY project HAVING count(DISTINCT v) > 1")
def d14_agreeing_fields(spark, d):
    text = F.concat(F.lit("前言 "), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("项目编号： P"), F.col("o_orderkey") % 3)).otherwise(""), F.lit(" 正文"))
    found = templates.agreeing_fields(t(spark, d, "orders").select(F.struct("o_custkey", "o_orderkey").alias("k"), text.alias("text")), "k")
    return templates.inconsistent(found.select(F.col("k.o_custkey").alias("project"), F.col("k.o_orderkey").alias("chapter"), "value"), "project", "chapter", "value")


@query(X + ", w(kind, term) AS (VALUES ('bid', '供应商'), ('bid', '采购'), ('bid', '供应'), ('bid', '询价'), ('bid', '报价'), ('procurement', '投标'), ('procurement', '招标')) SELECT id, w.term FROM x JOIN w ON contains(x.text, w.term) WHERE w.kind = CASE WHEN x.n % 2 = 0 THEN 'bid' ELSE 'procurement' END AND w.term IN ('供应商', '供应', '投标')")
def g6_forbidden_words(spark, d):
    kind = F.when(F.col("n") % 2 == 0, "bid").otherwise("procurement")
    x = rows(spark, d, "part", TENDER).select("id", "text", F.explode(templates.forbidden(kind)).alias("term"))
    return x.where(F.contains("text", "term")).select("id", "term").where(F.col("term").isin("供应商", "供应", "投标"))


@query("WITH x AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey), y AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS q FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT o_custkey, round(len(list_filter(p, lambda z: list_contains(q, z))) / len(p), 6) AS match_rate, round(least(len(p), len(q)) / greatest(len(p), len(q)), 6) AS count_ratio FROM x JOIN y USING (o_custkey)")
def d15_similarity(spark, d):
    pick = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == s, F.struct("o_orderkey", "o_orderpriority")))), lambda z: z["o_orderpriority"])
    x = t(spark, d, "orders").groupBy("o_custkey").agg(pick("O").alias("p"), pick("F").alias("q")).where("size(p) > 0 and size(q) > 0")
    x = x.select("o_custkey", templates.similarity(F.col("p"), F.col("q"), F.lit(True), F.lit(False)).alias("s"))
    return x.select("o_custkey", F.round("s.match_rate", 6).alias("match_rate"), F.round("s.count_ratio", 6).alias("count_ratio"))


@query()
def i8_auto_match(spark, d):
    """Whole scores need the common subsequence and Python's rounding, so no SQL; test_operators has the cases."""
    pick = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == s, F.struct("o_orderkey", "o_orderpriority")))), lambda z: z["o_orderpriority"])
    x = t(spark, d, "orders").groupBy("o_custkey").agg(pick("O").alias("p"), pick("F").alias("q")).where("size(p) > 0 and size(q) > 0")
    scored = x.select((F.col("o_custkey") % 10).alias("project"), F.col("o_custkey").alias("pos"), templates.similarity(F.col("p"), F.col("q"), F.lit(True), F.lit(False))["score"].alias("score"))
    return templates.best_templates(scored, "project")


@query("WITH a AS (SELECT l_orderkey, l_linenumber - 1 AS pos, min(l_returnflag) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber - 1 AS pos, min(l_linestatus) AS v FROM lineitem GROUP BY ALL) SELECT l_orderkey, pos, 3 AS changes, 'high' AS confidence FROM a JOIN b USING (l_orderkey, pos) WHERE a.v <> b.v")
def i7_findings(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("pos")).agg(F.min("l_returnflag").alias("a"), F.min("l_linestatus").alias("b"))
    return templates.findings(x.select("l_orderkey", "pos", F.col("a").alias("text")), x.select("l_orderkey", "pos", F.col("b").alias("text")), "l_orderkey")


@query("SELECT p_partkey AS id, p_size % 3 <> p_size % 2 OR p_size % 4 > 0 AS red_flag FROM part")
def d17_mechanical_check(spark, d):
    names = lambda k: F.repeat(F.lit("{{name}}"), (F.col("p_size") % k).cast("int"))
    table = lambda n: F.concat(F.lit("\n| a | b |\n|---|---|"), F.repeat(F.lit("\n| 1 | 2 |"), n))
    pairs = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(names(3), table(F.lit(1))).alias("a_text"), F.concat(names(2), table(1 + (F.col("p_size") % 4).cast("int"))).alias("b_text"))
    return templates.mechanical(pairs).select("id", "red_flag")


@query("SELECT p_partkey AS id, 1 + p_size % 4 AS n_rows, 2 AS n_columns FROM part")
def h40_table_shapes(spark, d):
    text = F.concat(F.lit("| a | b |\n|---|---|"), F.repeat(F.lit("\n| 1 | 2 |"), (F.col("p_size") % 4).cast("int")))
    s = templates.table_shape(T.markdown_rows(text))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), s["rows"].alias("n_rows"), s["columns"].alias("n_columns"))


@query("SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items FROM pages")
def a11_html_rows(spark, d):
    """The items of a page as rows of a table, read back as its cells."""
    table = F.regexp_replace(F.regexp_replace("html", "<li>", "<tr><td>"), "</li>", "</td></tr>")
    return t(spark, d, "pages").select("page_id", F.size(F.filter(T.html_rows(F.concat(F.lit("<table>"), table, F.lit("</table>"))), lambda r: F.size(r) == 1)).cast("long").alias("items"))


SAME = ("p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN '' ELSE p_name END AS a_text", "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN concat(p_name, ' ') WHEN 3 THEN concat(p_name, '!') ELSE reverse(p_name) END AS b_text", "cast(p_size % 4 AS int) AS a_pages", "1 AS b_pages")


@query(f"WITH x AS ({sql('part', SAME)}) SELECT id, CASE id % 5 WHEN 0 THEN a_pages = 1 WHEN 1 THEN false ELSE abs(a_pages - 1) <= 2 END AS same FROM x WHERE id % 5 <> 4")
def i4_same_content(spark, d):
    """Reversed names are asked too, by their ratio, and left out of the comparison: SQL has no such ratio."""
    return files.same_content(rows(spark, d, "part", SAME)).where("id % 5 <> 4").select("id", "same")


# A source has ten pages of blocks; every third chapter is the format chapter, with or without children and a cover.
NODES = "WITH s AS (SELECT DISTINCT cast(s_suppkey AS bigint) AS source FROM supplier), n AS (SELECT source, 0 AS pos, CAST(NULL AS int) AS parent, '第一章 公告' AS title, 0 AS start_page, 2 AS end_page FROM s UNION ALL SELECT source, 1, NULL, '第二章 投标文件 格式', 3, 9 FROM s UNION ALL SELECT source, 2, 1, '封面', 3, 3 FROM s WHERE source % 2 = 0 UNION ALL SELECT source, 3, 1, '投标函', 4, 5 FROM s WHERE source % 3 > 0 UNION ALL SELECT source, 4, 1, '授权书', 6, 9 FROM s WHERE source % 3 = 1)"


def plan_inputs(spark, d):
    t(spark, d, "supplier").createOrReplaceTempView("foliary_supplier")
    nodes = spark.sql(NODES.replace("FROM supplier", "FROM foliary_supplier") + " SELECT * FROM n")
    pages = t(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("page_idx"))
    title = F.when(F.col("page_idx") == 3, "第二章 投标文件格式").otherwise(F.concat(F.lit("附件"), "page_idx"))
    heads = pages.select("source", (F.col("page_idx") * 2).alias("block_idx"), "page_idx", title.alias("text"), F.when((F.col("page_idx") % 2 == 1) & (F.col("source") % 6 > 0), 1).alias("text_level"))
    body = pages.select("source", (F.col("page_idx") * 2 + 1).alias("block_idx"), "page_idx", F.lit("正文").alias("text"), F.lit(None).cast("int").alias("text_level"))
    return nodes, heads.unionByName(body)


PLAN = NODES + ", p AS (SELECT source, 0 AS seq, '封面' AS title, 3 AS start_page, 3 AS end_page FROM s WHERE source % 2 = 0 UNION ALL SELECT source, row_number() OVER (PARTITION BY source ORDER BY pos), title, start_page, end_page FROM n WHERE pos > 2 UNION ALL SELECT source, k, concat('附件', 3 + 2 * k), 3 + 2 * k, CASE k WHEN 3 THEN 9 ELSE 4 + 2 * k END FROM s, (VALUES (1), (2), (3)) v(k) WHERE source % 3 = 0 AND source % 6 > 0 UNION ALL SELECT source, 1, '第二章 投标文件 格式', 3, 9 FROM s WHERE source % 6 = 0)"


@query(PLAN + " SELECT source, CAST(seq AS INTEGER) AS seq, title, start_page, end_page FROM p")
def g9_section_plan(spark, d):
    return sections.section_plan(*plan_inputs(spark, d)).select("source", F.col("seq").cast("int").alias("seq"), "title", "start_page", "end_page")


@query(PLAN + ", b AS (SELECT source, CAST(q AS INTEGER) AS page_idx, 2 * q AS block_idx, CASE q WHEN 3 THEN '第二章投标文件格式' ELSE concat('附件', q) END AS norm, q % 2 = 1 AND source % 6 > 0 AS heads FROM s, range(10) r(q) UNION ALL SELECT source, q, 2 * q + 1, '正文', false FROM s, range(10) r(q)) SELECT p.source, CAST(seq AS INTEGER) AS seq, count(*) AS blocks FROM p JOIN b ON p.source = b.source AND page_idx BETWEEN start_page AND end_page AND NOT (heads AND page_idx = start_page AND norm = replace(title, ' ', '')) GROUP BY ALL")
def b11_section_blocks(spark, d):
    nodes, blocks = plan_inputs(spark, d)
    return sections.section_blocks(blocks, sections.section_plan(nodes, blocks)).groupBy("source", F.col("seq").cast("int").alias("seq")).agg(F.count("*").alias("blocks"))
