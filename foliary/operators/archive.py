"""Archiving uploads: recognised lines to text, repeated page lines left out, names, stored rows, words and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import chapters, files
from foliary.operators.phrase_index import PhraseIndex

# What may be uploaded, and as what.
CATEGORIES = ("qualification", "personnel", "performance", "honor", "finance")
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff", "pdf", "doc", "docx")
LEAST_SCORE = 0.5


def recognised(lines: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Recognised lines (.., text, score) that are sure enough; one without a score counts as sure. A null text is no line."""
    return lines.where(F.col("text").isNotNull() & (F.col("score").isNull() | (F.col("score") >= least)))


def page_text(lines: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key.., text): a page's lines in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy(*key).agg(joined.alias("text"))


def contained(base: Column, target: Column) -> Column:
    """Whether an absolute target path lies in base or is it, once ``.`` and ``..`` are taken away; ``..`` above the root
    stays there. Links aren't followed. A null path, or one that isn't absolute, is not contained."""
    parts = lambda p: F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    step = lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x)))
    resolved = lambda p: F.aggregate(parts(p), F.array().cast("array<string>"), step)
    a, b = resolved(base), resolved(target)
    return F.coalesce(base.startswith("/") & target.startswith("/") & (F.slice(b, F.lit(1), F.greatest(F.size(a), F.lit(1))) == a) | (base.startswith("/") & target.startswith("/") & (F.size(a) == 0)), F.lit(False))


def archived(uploads: DataFrame, lines: DataFrame, root: Column) -> DataFrame:
    """uploads (id, tenant, category, file) with their recognised lines (id, page_idx, pos, text, score) as materials:
    (id, tenant, category, name, file_name, path, text, problem).

    An unknown category or extension is a problem, and so is a path that leaves root; such an upload keeps its row, without
    a text. Short lines that stand on several pages are watermarks or headers and go; pages are joined by line breaks. Equal
    names of a tenant and category get -1, -2 in the order of their ids.
    """
    ext = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    kind = F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "category").when(~F.coalesce(ext.isin(*EXTENSIONS), F.lit(False)), "extension")
    name = T.safe_name(F.regexp_replace("file", r"\.[^./]*$", ""))
    rows = uploads.withColumns({"problem": kind, "name": name, "whole": F.concat_ws("/", root, F.col("tenant"), F.col("category"), F.regexp_replace("file", r"\.[^./]*$", ""))})
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(~contained(root, F.col("whole")), "path")))
    good = rows.where("problem is null").withColumn("place", F.concat_ws("/", "tenant", "category", "name"))
    unique = files.unique_names(good.select("id", F.col("place").alias("name")), "name", "id").select("id", F.concat("name", F.lit(".png")).alias("path"))
    kept = recognised(lines).select(F.col("id").alias("doc_id"), "page_idx", "pos", F.trim("text").alias("text"))
    marks = chapters.repeated_short_lines(kept).select("doc_id", "text")
    pages = page_text(kept.join(marks, ["doc_id", "text"], "left_anti").withColumn("at", F.struct("page_idx", "pos")), ["doc_id"], "at").select(F.col("doc_id").alias("id"), "text")
    done = rows.join(unique, "id", "left").join(pages, "id", "left")
    text = F.when(F.col("problem").isNull(), F.coalesce("text", F.lit("")))
    return done.select("id", "tenant", "category", F.when(F.col("problem").isNull(), F.col("name")).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.when(F.col("path").isNotNull(), F.concat_ws("/", root, F.col("path"))).alias("path"), text.alias("text"), "problem")


def indexed(index: PhraseIndex, materials: DataFrame, removed: DataFrame | None = None) -> int:
    """Puts archived or restored materials (id, tenant, name, text) into a phrase index; those with a problem aren't."""
    return index.upsert(materials.where("problem is null").select("tenant", "id", "name", "text") if "problem" in materials.columns else materials, removed)
