"""Readers and writers: landed files, block lists, keyword lists, server-sent progress events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.sources.versioned import Files, VersionedTable

BLOCK = "type string, text string, page_idx int, text_level int, bbox array<double>, table_body string, img_caption string"
BLOCKS = f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in BLOCK.split(', '))}>>"
ACCEPTED = ("pdf", "doc", "docx")


def land(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """(name, ext, size, sha256) of accepted files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(T.safe_name(F.element_at(F.split("path", "/"), -1)).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    rows = rows.withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))).where(F.col("ext").isin(*ACCEPTED))
    return rows.where(F.col("size") <= most_bytes) if most_bytes else rows


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Block lists (one JSON array a file) with source_stem; a file that is no array of blocks fails the read."""
    rows = spark.read.schema(BLOCK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("source_stem", T.file_stem(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))


def read_keywords(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """(category, value) of a JSON object of word lists; unknown names are left out."""
    rows = spark.read.schema(", ".join(f"{n} array<string>" for n in names)).option("multiLine", True).json(path)
    return rows.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("category", "values")).select("category", F.explode("values").alias("value"))


def parsed_blocks(json: F.Column) -> F.Column:
    """The blocks in a JSON text; null if it is no array."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, BLOCKS))


def parsed_keywords(rows: DataFrame, key: str, json: str, names: tuple[str, ...] = ("certificate_types", "person_names", "project_keywords", "honor_types", "custom")) -> DataFrame:
    """(key, category, value) of JSON objects of word lists; unknown names are left out, absent ones are empty."""
    lists = F.from_json(json, ", ".join(f"{n} array<string>" for n in names))
    found = rows.select(key, F.explode(F.create_map(*[x for n in names for x in (F.lit(n), lists[n])])).alias("category", "values"))
    return found.select(key, "category", F.explode("values").alias("value"))


def requirements(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, category, item, material) of score tables as JSON; a table that doesn't parse has none."""
    form = "categories array<struct<name: string, items: array<struct<name: string, materials: array<string>>>>>"
    found = rows.select(key, F.explode(F.from_json(json, form)["categories"]).alias("c")).select(key, F.col("c.name").alias("category"), F.explode("c.items").alias("i"))
    return found.select(key, "category", F.col("i.name").alias("item"), F.explode("i.materials").alias("material"))


def write_json(df: DataFrame, path: str) -> None:
    """Replaces a folder of JSON lines by a finished one: a job that fails leaves the old files. ``put_json`` has no moment
    between the two, and keeps versions."""
    files = Files(df.sparkSession, path)
    draft, old = (f"{path.rstrip('/')}.{uuid.uuid4().hex}.{k}" for k in ("new", "old"))
    df.write.json(draft)
    files.move(path, old)
    files.move(draft, path)
    files.delete(old)


def put_json(df: DataFrame, path: str, key: str) -> int:
    """Replaces the rows of df's values of ``key`` in a table of JSON lines; readers see the new files all at once, and the
    old ones if the job fails. Returns the version."""
    return VersionedTable(df.sparkSession, path, key, df.schema, form="json").replace(df)


def read_json(spark: SparkSession, path: str, key: str, schema: str, version: int | None = None) -> DataFrame:
    """What ``put_json`` has written, by now or as of a version."""
    return VersionedTable(spark, path, key, schema, form="json").read(version).drop("v")


def parse_events(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Progress events of ``data:`` lines, with the columns to keep in front; works on a batch and on a stream."""
    body = F.regexp_extract(column, r"^data:\s*(.*)$", 1)
    rows = lines.where(F.col(column).startswith("data:")).select(*(keep or []), F.from_json(body, "stage string, percent int, message string").alias("e"))
    return rows.select(*(keep or []), "e.*").withColumn("terminal", F.col("stage").isin("completed", "failed", "cancelled"))
