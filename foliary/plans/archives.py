"""Queries of the archive: recognised lines, paths, the whole flow with its index, and restores that are found again."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import archive, chapters, relational
from foliary.operators.phrase_index import PhraseIndex
from foliary.plans.catalog import LINES, query, t
from foliary.plans.index import NAMED, _search, named, shown
from foliary.sources.versioned import scratch

# A document's lines as recognised ones, with a score that some don't have.
SCORED = "r AS (SELECT doc_id, page_idx, block_idx, text, CASE WHEN block_idx % 10 = 0 THEN NULL ELSE (block_idx * 37 % 100) / 100.0 END AS score FROM blocks), s AS (SELECT * FROM r WHERE score IS NULL OR score >= 0.5)"


def scored(spark, d):
    score = F.when(F.col("block_idx") % 10 != 0, (F.col("block_idx") * 37 % 100) / 100)
    return chapters.blocks(t(spark, d, "documents")).withColumn("score", score)


@query(f"WITH {LINES}, {SCORED} SELECT doc_id, page_idx, sha256(string_agg(text, chr(10) ORDER BY block_idx)) AS digest, count(*) AS lines FROM s GROUP BY ALL")
def a16_recognised_lines(spark, d):
    kept = archive.recognised(scored(spark, d))
    text = archive.page_text(kept, ["doc_id", "page_idx"], "block_idx")
    return text.join(kept.groupBy("doc_id", "page_idx").agg(F.count("*").alias("lines")), ["doc_id", "page_idx"]).select("doc_id", "page_idx", F.sha2("text", 256).alias("digest"), "lines")


@query("SELECT doc_id, doc_id % 5 IN (0, 1, 4) AS inside FROM documents")
def b15_contained_paths(spark, d):
    """Paths of documents under their source: plain, through a folder and back, out of it, a sibling by prefix, itself."""
    base = F.concat(F.lit("/data/"), F.coalesce("source", F.lit("none")))
    forms = [F.concat(base, F.lit("/"), "doc_id"), F.concat(base, F.lit("/a/.././b//"), "doc_id"), F.concat(base, F.lit("/../../etc/"), "doc_id"), F.concat(base, F.lit("-other/"), "doc_id"), F.concat(base, F.lit("/x/../"))]
    return t(spark, d, "documents").select("doc_id", archive.contained(base, F.element_at(F.array(*forms), (F.col("doc_id") % 5 + 1).cast("int"))).alias("inside"))


UPLOADS = "u AS (SELECT doc_id AS id, ['qualification', 'personnel', 'honor', 'finance', 'other'][doc_id % 5 + 1] AS category, ['png', 'PDF', 'docx', 'exe', 'jpg', 'tiff', 'pdf'][doc_id % 7 + 1] AS ext, doc_id % 11 = 3 AS out FROM documents), v AS (SELECT *, CASE WHEN category = 'other' THEN 'category' WHEN ext = 'exe' THEN 'extension' WHEN out THEN 'path' END AS problem FROM u)"


@query(f"WITH {LINES}, {SCORED}, {UPLOADS}, m AS (SELECT doc_id, text FROM s WHERE length(text) BETWEEN 1 AND 20 GROUP BY ALL HAVING count(DISTINCT page_idx) >= 2), x AS (SELECT s.doc_id, string_agg(s.text, chr(10) ORDER BY page_idx, block_idx) AS text FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = s.doc_id AND m.text = s.text) GROUP BY s.doc_id), k AS (SELECT id, row_number() OVER (PARTITION BY category, id % 20 ORDER BY id) - 1 AS n FROM v WHERE problem IS NULL) SELECT v.id, v.category, CASE WHEN problem IS NULL THEN 'scan_' || (v.id % 20) || CASE WHEN n > 0 THEN '-' || n ELSE '' END || '.png' END AS file_name, CASE WHEN problem IS NULL THEN sha256(coalesce(x.text, '')) END AS digest, problem FROM v LEFT JOIN k USING (id) LEFT JOIN x ON x.doc_id = v.id")
def a19_archived(spark, d):
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % by + 1).cast("int"))
    stem = F.concat(F.when(F.col("doc_id") % 11 == 3, "../../../scan_").otherwise("scan_"), (F.col("doc_id") % 20).cast("string"))
    uploads = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("t").alias("tenant"), pick(["qualification", "personnel", "honor", "finance", "other"], 5).alias("category"), F.concat(stem, F.lit("."), pick(["png", "PDF", "docx", "exe", "jpg", "tiff", "pdf"], 7)).alias("file"))
    lines = scored(spark, d).select(F.col("doc_id").alias("id"), "page_idx", F.col("block_idx").alias("pos"), "text", "score")
    return archive.archived(uploads, lines, F.lit("/data")).select("id", "category", "file_name", F.sha2("text", 256).alias("digest"), "problem")


@query(f"WITH RECURSIVE {NAMED}, m AS (SELECT * FROM n WHERE id % 4 > 0 OR id % 3 > 0), {_search('ation', 'm')}")
def j2_restored_and_found(spark, d):
    """Every fourth document was deleted and taken out of the index; those whose restore succeeds are found again."""
    x = named(spark, d)
    index = PhraseIndex(spark, scratch(spark, "index"), ["name", "text"])
    gone = x.where("id % 4 = 0")
    index.rebuild(x)
    index.upsert(x.limit(0), gone)
    target = gone.select(F.col("id").alias("ref_id"), F.when(F.col("id") % 3 > 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    outcome = relational.restored(gone.select(F.col("id").alias("ref_id"), F.col("tenant").alias("parent")), target, x.select(F.col("tenant").alias("parent")))
    back = outcome.where("outcome = 'restored'").select(F.col("ref_id").alias("id"))
    archive.indexed(index, x.join(back, "id", "left_semi"))
    return shown(index.search("ation"))
