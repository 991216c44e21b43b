"""Queries whose answer depends on the texts themselves: ratios, diffs of several lines, findings, rule packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import chapters, files, packs, templates
from foliary.plans.catalog import LINES, query, t
from foliary.plans.domain import TENDER, X, rows


@query()
def i4_ratio_content(spark, d):
    """Each document against itself with its spacing changed and a tail cut or added, so that only the ratio tells; there is
    no SQL for it, tests hold it against the standard library."""
    x = t(spark, d, "documents")
    cut = F.substring("text", F.lit(1), (F.length("text") * (60 + F.col("doc_id") % 40) / 100).cast("int"))
    other = F.concat(F.replace(cut, F.lit(" "), F.lit("  ")), F.lit(" "), F.repeat(F.lit("z"), (F.col("doc_id") % 50).cast("int")))
    pairs = x.select("doc_id", F.col("text").alias("a_text"), other.alias("b_text"), F.lit(1).alias("a_pages"), (1 + F.col("doc_id") % 4).cast("int").alias("b_pages"))
    return files.same_content(pairs).select("doc_id", "same")


@query()
def c12_similar_files(spark, d):
    """Files of a name group (three documents each, the second one a shortened copy of the first) whose contents agree."""
    x = t(spark, d, "documents").select("doc_id", F.expr("doc_id div 3").alias("g"), (F.col("doc_id") % 3).alias("k"), "text")
    copy = x.where("k = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "g", F.lit(3).cast("long").alias("k"), F.expr("substring(text, 1, cast(length(text) * (50 + doc_id % 50) / 100 as int))").alias("text"))
    every = x.unionByName(copy)
    # Shortened before the join, each text once.
    side = lambda p, name: every.select("g", F.col("k").alias(f"{p}_k"), F.col("doc_id").alias(name), files.compared(F.col("text")).alias(f"{p}_text"), F.lit(1).alias(f"{p}_pages"))
    return files.same_content(side("a", "first").join(side("b", "other"), "g").where("a_k < b_k"), shortened=True).where("same").select("first", "other")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 ELSE doc_id % 4 + 1 + CAST(coalesce(text, '') = '' OR ends_with(text, chr(10)) AS INTEGER) END AS changes FROM documents")
def i6_added_lines(spark, d):
    """Whole texts of many lines against themselves with up to three lines added: those, the line that a break at the end
    opens, and the header's line."""
    x = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = F.concat("text", F.repeat(F.lit("\nan added line"), (F.col("doc_id") % 4).cast("int")))
    return x.select("doc_id", templates.changes(F.col("text"), other).cast("long").alias("changes"))



@query(f"WITH {LINES}, p AS (SELECT DISTINCT doc_id, page_idx FROM blocks) SELECT doc_id, 'p' || page_idx AS chapter, 'unmatched' AS kind, CAST(NULL AS INTEGER) AS place, CAST(NULL AS INTEGER) AS changes, 'high' AS confidence, 'manual_review' AS action, false AS red_flag, false AS disclosure FROM p WHERE page_idx % 4 = 3 UNION ALL SELECT doc_id, 't' || page_idx, 'unmatched', NULL, NULL, 'high', 'keep', false, false FROM p WHERE page_idx % 4 = 3 UNION ALL SELECT b.doc_id, 'p' || b.page_idx, 'paragraph', CAST(b.block_idx - 20 * b.page_idx AS INTEGER), 3, 'high', 'update', false, false FROM blocks b WHERE b.page_idx % 4 = 1 AND b.text <> '' AND b.block_idx % 2 = 0 UNION ALL SELECT doc_id, 'p' || page_idx, 'mechanical', NULL, NULL, 'high', 'update', true, false FROM p WHERE page_idx % 4 = 2 UNION ALL SELECT b.doc_id, 'p' || b.page_idx, 'paragraph', CAST(b.block_idx - 20 * b.page_idx AS INTEGER), 3, 'high', 'update', false, false FROM blocks b WHERE b.page_idx % 4 = 2 AND b.block_idx % 20 = 0 AND b.text <> '' UNION ALL SELECT b.doc_id, 'p' || b.page_idx, 'paragraph', 0, 2, 'high', 'update', false, false FROM blocks b WHERE b.page_idx % 4 = 2 AND b.block_idx % 20 = 0 AND b.text = ''")
def i7_all_findings(spark, d):
    """A document's pages as chapters against pages of a template: equal ones, some with other paragraphs, some with a
    placeholder more, and some that have no counterpart on either side."""
    page = chapters.blocks(t(spark, d, "documents")).select("doc_id", "page_idx", (F.col("block_idx") - 20 * F.col("page_idx")).alias("pos"), F.translate("text", "|{}", "   ").alias("text"))
    page = page.withColumn("text", F.when(F.trim("text") == "", "").otherwise(F.col("text")))
    side = lambda letter, text: page.select("doc_id", F.concat(F.lit(letter), F.col("page_idx").cast("string")).alias("chapter"), "pos", text.alias("text"))
    kind = F.col("page_idx") % 4
    edited = F.when((kind == 1) & (F.col("pos") % 2 == 0) & (F.col("text") != ""), F.concat("text", F.lit("!"))).when((kind == 2) & (F.col("pos") == 0), F.concat("text", F.lit("{{name}}"))).otherwise(F.col("text"))
    named = page.select("doc_id", "page_idx").distinct().select("doc_id", F.concat(F.lit("p"), F.col("page_idx").cast("string")).alias("chapter"), F.when(kind != 3, F.concat(F.lit("t"), F.col("page_idx").cast("string"))).alias("template"))
    return templates.comparison(named, side("p", F.col("text")), side("t", edited), "doc_id")


@query(X + " SELECT DISTINCT id, kind, value FROM (SELECT id, 'page_limit' AS kind, unnest(regexp_extract_all(text, '(?:不超过|不得超过|不得多于|控制在|限制在)\\s*(\\d{1,4})\\s*页', 1)) || '页' AS value FROM x)")
def h5_packaged_pack(spark, d):
    """The packaged rules as rows; the page limits are compared, h5_constraints has all kinds of the expressions."""
    x = rows(spark, d, "part", TENDER).select("id", "text")
    return packs.packed_constraints(x, packs.pack(spark), ["id"]).where("kind = 'page_limit'").select("id", "kind", "value")


ENGLISH = (
    packs.Rule("version", "version", r"[Vv]ersion\s*(\d+(?:\.\d+)?)", None, ("ersion",), "v{1}"),
    packs.Rule("licence", "licence", r"(CC BY(?:-[A-Z]{2})*) (\d\.\d)", r"[Ll]icensed", ("CC BY",), "{1} {2}"),
    packs.Rule("phone", "phone number", r"\+1 \((\d{3})\) (\d{3}-\d{4})", None, ("+1 (",), "{1}-{2}"),
)


@query("WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents), f AS (SELECT doc_id, line, 'version' AS kind, 'v' || unnest(regexp_extract_all(line, '[Vv]ersion\\s*(\\d+(?:\\.\\d+)?)', 1)) AS value FROM l UNION ALL SELECT doc_id, line, 'licence', unnest(list_transform(list_zip(regexp_extract_all(line, '(CC BY(?:-[A-Z]{2})*) (\\d\\.\\d)', 1), regexp_extract_all(line, '(CC BY(?:-[A-Z]{2})*) (\\d\\.\\d)', 2)), lambda p: p[1] || ' ' || p[2])) FROM l WHERE regexp_matches(line, '[Ll]icensed') UNION ALL SELECT doc_id, line, 'phone', unnest(list_transform(list_zip(regexp_extract_all(line, '\\+1 \\((\\d{3})\\) (\\d{3}-\\d{4})', 1), regexp_extract_all(line, '\\+1 \\((\\d{3})\\) (\\d{3}-\\d{4})', 2)), lambda p: p[1] || '-' || p[2])) FROM l) SELECT doc_id, kind, value, count(DISTINCT line) AS lines FROM f GROUP BY ALL")
def h5_english_pack(spark, d):
    """Another domain's rules over all lines of documents, through the same operator."""
    lines = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    found = packs.packed_constraints(lines, packs.pack(spark, ENGLISH), ["doc_id"])
    return found.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("lines"))
