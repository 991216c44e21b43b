"""Golden cases of the document operators."""

import pytest
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import chapters, files, relational, rules, search, templates, workflow
from foliary.sources import readers


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("第一章 招标公告", (1, "第一章", "招标公告")),
        ("1.2.3 范围", (4, "1.2.3", "范围")),
        ("一、项目概述", (2, "一、", "项目概述")),
        ("（二）要求", (3, "（二）", "要求")),
        ("3. 其他", (3, "3.", "其他")),
        ("封面", (1, "", "封面")),
        ("这是一句话。", None),
        ("第一章", None),
    ],
)
def test_heading(spark, text, want):
    got = one(spark, text, T.heading)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("text,want", [("招标文件 投标人", "招标"), ("采购需求 供应商 成交", "采购"), ("询比价公告", "询比价"), ("其他", "未知")])
def test_doc_type(spark, text, want):
    assert one(spark, text, T.doc_type) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("监理大纲页数不超过50页。", [("page_limit", "50页")]),
        ("投标保证金金额为5万元", [("amount", "5万元")]),
        ("服务期限12个月", [("period", "12月")]),
        ("提供近6个月的社保证明", [("period", "6月"), ("social_security", "6个月")]),
        ("社保缴纳证明 3 个月", [("period", "3月"), ("social_security", "3个月")]),
        ("正本1份，副本4份", [("quantity", "正本1份"), ("quantity", "副本4份")]),
        ("共 3 份", [("quantity", "3 份")]),
        ("无", []),
    ],
)
def test_constraints(spark, text, want):
    assert [tuple(r) for r in one(spark, text, T.constraints)] == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("近3年业绩，有效期至2025年12月1日，三年内", [("date", "3年"), ("date", "2025-12-01")]),
        ("单项合同额不低于500万元", [("amount", "500万元")]),
        ("≥3个业绩，至少2项，5人以上", [("quantity", "3个"), ("quantity", "2项"), ("quantity", "5人")]),
        ("5年内", [("date", "5年内")]),
    ],
)
def test_thresholds(spark, text, want):
    assert [tuple(r) for r in one(spark, text, T.thresholds)] == want


def test_similarity(spark):
    rows = [(["一", "二"], ["一", "二"]), (["1. 甲", "乙", "丙", "丁"], ["甲", "乙"]), (["甲"], ["乙"]), ([], ["甲"])]
    df = spark.createDataFrame(rows, "p array<string>, q array<string>")
    both = [tuple(r["s"]) for r in df.select(templates.similarity(F.col("p"), F.col("q"), F.lit(True), F.lit(True)).alias("s")).collect()]
    none = [tuple(r["s"]) for r in df.select(templates.similarity(F.col("p"), F.col("q"), F.lit(False), F.lit(False)).alias("s")).collect()]
    assert [b[0] for b in both] == [100.0, 100.0, 95.0, 75.0]
    assert none == [(85.0, 1.0, 1.0, 1.0), (42.5, 0.5, 0.5, 0.5), (20.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
    halves = spark.createDataFrame([(0.15, 1), (2.675, 2), (2.5, 0)], "x double, d int")
    assert [r[0] for r in halves.select(templates.rounded("x", "d")).collect()] == [0.1, 2.67, 2.0]


def test_anchor_needs_text(spark):
    rows = spark.createDataFrame([("投标　函", "一份投标\n函", True), ("x", "abc", False), ("  ", "abc", False)], "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", T.anchored(F.col("a"), F.col("b"))).collect())


def test_placeholders_and_syntax(spark):
    assert one(spark, "{% if a %}{{ name }}{{name}}{{ seal_image }}{% endif %}", T.placeholders) == ["name", "seal_image"]
    assert one(spark, "{% for x in y %}{{ 1bad }}", T.syntax_errors) == ["for", "name"]
    assert one(spark, "2025-01-05", T.compact_date) == "20250105"
    assert one(spark, "2025年", T.compact_date) == "changqi"


def test_segmentation(spark):
    lines = ["目录", "第一章 公告..... 1", "第二章 须知..... 5"] + [""] * 17 + ["第一章 公告", "一、概述", "（一）范围", "二、资格", "第二章 须知"] + ["x"] * 20 + ["第二章 须知"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    rows = chapters.blocks(docs)
    assert [r["page_idx"] for r in chapters.toc_pages(rows).collect()] == [0]
    found = chapters.without_running_headers(chapters.headings(rows))
    tree = {r["title"]: r for r in chapters.tree(found).collect()}
    assert set(tree) == {"公告", "概述", "范围", "资格", "须知"}
    assert tree["概述"]["parent"] == tree["公告"]["block_idx"] and tree["范围"]["parent"] == tree["概述"]["block_idx"]
    assert (tree["资格"]["seq"], tree["须知"]["parent"], tree["须知"]["end_page"]) == (2, None, 1)


def test_files(spark):
    rows = spark.createDataFrame([("资格证明-1.pdf",), ("资格证明.doc",), ("a.txt",)], "stored_name string")
    got = {r["stored_name"]: r["is_primary"] for r in files.grouped(rows).collect()}
    assert got == {"资格证明-1.pdf": False, "资格证明.doc": True}
    pairs = spark.createDataFrame([(1, "a b", 1, "ab", 2), (2, "", 1, "", 1), (3, "", 1, "x", 1), (4, "abc", 1, "abc", 9), (5, "abcdefghij", 1, "abcdefghix", 1)], "k int, a_text string, a_pages int, b_text string, b_pages int")
    assert {r["k"]: r["same"] for r in files.same_content(pairs).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_rules_and_scores(spark):
    sections = spark.createDataFrame([("s", "1", [], "初步评审"), ("s", "2", ["1"], "评审细则"), ("s", "3", [], "其他")], "source string, node_id string, ancestors array<string>, title string")
    pack = spark.createDataFrame([("review", "contains", "评审")], "rule string, kind string, keyword string")
    hits = rules.keyword_hits(sections, pack)
    assert {r["node_id"] for r in hits.collect()} == {"1", "2"}
    assert {r["node_id"] for r in rules.outermost(hits).collect()} == {"1"}
    assert one(spark, "每项5分，满分20分", rules.line_score) == 20.0
    items = spark.createDataFrame([("t", "a", 40.0), ("t", "b", 60.0)], "k string, category string, score double")
    assert tuple(rules.totals(items, "k").first()) == ("t", 2, 100.0, True)


def test_search(spark):
    docs = spark.createDataFrame([(1, "abcabc xyz"), (2, "ABC"), (3, "zzz"), (4, None)], "id long, body string")
    assert {r["id"] for r in search.bm25(docs, "id", "body", "abc").collect()} == {1, 2}
    assert {r["id"] for r in search.bm25(docs, "id", "body", "xy").collect()} == {1}
    assert search.bm25(docs, "id", "body", " ").count() == 0


def test_templates(spark):
    p = spark.createDataFrame([(1, 0, "1 A"), (1, 1, "B"), (1, 2, "C")], "k int, pos int, name string")
    t = spark.createDataFrame([(1, 0, "x"), (1, 1, "a")], "k int, pos int, name string")
    assert {r["pos"]: (r["template"], r["how"]) for r in templates.associated(p, t, "k").collect()} == {0: ("a", "name"), 1: ("a", "place"), 2: (None, "none")}


def test_workflow(spark):
    changes = spark.createDataFrame([("INIT", "UPLOADED"), ("INIT", "PARSED"), ("EXPORTED", "INIT")], "from_state string, to_state string")
    assert sorted(r["legal"] for r in workflow.legal(changes, workflow.edges(spark)).collect()) == [False, False, True]
    items = spark.createDataFrame([("j", "running"), ("j", "success")], "job string, state string")
    assert relational.roll_up(workflow.resumed(items), "job").first()["job_state"] == "idle"


def test_scope_and_events(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id int, tenant string, deleted_at timestamp")
    assert [r["id"] for r in relational.scoped(rows, tenant="a").collect()] == [1]
    with pytest.raises(ValueError):
        relational.scoped(rows, tenant=None)
    lines = spark.createDataFrame([('data: {"stage":"completed","percent":100,"message":"ok"}',), ("",)], "value string")
    assert readers.parse_events(lines).first()["terminal"]


def test_sources(spark, tmp_path):
    """Files land with size and digest; block lists, word lists and docx files are read; JSON is written whole."""
    import hashlib

    from foliary.sources import docx

    (tmp_path / "in").mkdir()
    made = docx.docx_of(["第一章 总则", "", "a <b> & c"])
    (tmp_path / "in" / "甲 乙.docx").write_bytes(made)
    (tmp_path / "in" / "note.txt").write_text("no")
    landed = readers.land(spark, str(tmp_path / "in")).collect()
    assert [(r["ext"], r["size"], r["sha256"]) for r in landed] == [("docx", len(made), hashlib.sha256(made).hexdigest())]
    assert readers.land(spark, str(tmp_path / "in"), 10).count() == 0
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    rows = docx.paragraphs(files.select("path", "content"), "path").collect()
    assert [(r["pos"], r["kind"], r["text"]) for r in rows] == [(0, "paragraph", "第一章 总则"), (2, "paragraph", "a <b> & c")]
    (tmp_path / "blocks").mkdir()
    (tmp_path / "blocks" / "one-2.json").write_text('[{"type": "text", "text": "x", "page_idx": 1}, {"type": "table", "extra": 1}]')
    assert sorted((r["source_stem"], r["type"]) for r in readers.read_blocks(spark, str(tmp_path / "blocks")).collect()) == [("one", "table"), ("one", "text")]
    (tmp_path / "words.json").write_text('{"custom": ["a", "b"], "unknown": ["c"]}')
    assert [tuple(r) for r in readers.read_keywords(spark, str(tmp_path / "words.json"), ("custom", "person_names")).collect()] == [("custom", "a"), ("custom", "b")]
    readers.write_json(spark.range(3), str(tmp_path / "out"))
    readers.write_json(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_progress_as_a_stream(spark, tmp_path):
    """The same frames, read as they come; the stream's last event of each job is the batch's."""
    (tmp_path / "frames").mkdir()
    (tmp_path / "frames" / "a.txt").write_text('data: {"stage":"running","percent":10,"message":"m"}\n\ndata: {"stage":"completed","percent":100,"message":"m"}\n')
    lines = spark.readStream.schema("value string").text(str(tmp_path / "frames"))
    seen = readers.parse_events(lines).writeStream.format("memory").queryName("frames").trigger(availableNow=True).start()
    seen.awaitTermination()
    assert sorted(r["percent"] for r in spark.table("frames").where("terminal or percent = 10").collect()) == [10, 100]


def test_walks(spark):
    """What was found before decides: headings never go back, requests that are illegal change nothing."""
    moves = spark.createDataFrame([("p", 1, "UPLOADED"), ("p", 2, "PARSED"), ("p", 3, "PARSING"), ("p", 4, "INIT")], "k string, at int, to_state string")
    log = workflow.audited(moves, workflow.TRANSITIONS, "k", ["at"]).orderBy("at").collect()
    assert [(r["from_state"], r["legal"]) for r in log] == [("INIT", True), ("UPLOADED", False), ("UPLOADED", True), ("PARSING", False)]
    closure = {(r["stage"], r["below"]) for r in workflow.below(spark).collect()}
    assert ("mineru", "score:llm") in closure and ("score:llm", "mineru") not in closure and ("dedupe", "dedupe") in closure
    texts = spark.createDataFrame([(1, "aXbaX"), (2, "nothing"), (3, "")], "k int, text string")
    terms = spark.createDataFrame([("aX",), ("b",), ("",)], "term string")
    assert {(r["k"], r["term"]): r["n"] for r in templates.occurrences(texts, terms, "k").collect()} == {(1, "aX"): 2, (1, "b"): 1}
