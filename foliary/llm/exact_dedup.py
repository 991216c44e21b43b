"""Exact dedup (8): stateful streaming deduplication over disk-backed keyed state.

A stream of (digest, identifier, locator) feeds a keyed aggregate whose state lives in RocksDB, without watermark
and so without expiry: per digest it retains the row that stays, its content locator and the number of rows. Hits
(digests of several rows) are checked on their full bytes; should two texts ever share a digest, they part by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import textops
from foliary.llm.common import shared_folder, table, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: RocksDB keeps the state; without fallocate each of many small stores takes the disk that it fills, not megabytes ahead,
#: and all stores of an executor share one bound of memory.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _digests(digest: Callable[[bytes], str], last: str = "locator") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.batches(source):
            data, at = textops.utf8(batch.column(1), lower=True)
            view = memoryview(data.tobytes())
            found = [digest(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            kept = batch.column(2) if last == "locator" else pa.array([bytes(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            row = batch.columns[3:]
            yield pa.record_batch([batch.column(0), kept, pa.array(found, pa.string()), *row], names=["id", last, "digest", "row"][: 3 + len(row)])

    return run


def keyed_state(rows: DataFrame) -> DataFrame:
    """(digest, keep, group_size) from a written table with digest, id, row and locator, read as a stream.

    The state stays on disk in RocksDB and is committed to the shared folder, so a lost executor's part is loaded
    again elsewhere. Each call begins with no state.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    source = {f.rpartition("/")[0] for f in rows.inputFiles()}
    stream = spark.readStream.schema(rows.schema).parquet(*source)
    state = stream.groupBy("digest").agg(F.max(F.struct("id", "row", "locator")).alias("keep"), F.count("*").alias("group_size"))
    was = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.format("statestore").load(folder)
    value = kept.schema["value"].dataType.names
    return kept.select(F.col("key.digest").alias("digest"), F.col("value")[value[0]].alias("keep"), F.col("value")[value[1]].alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], str] = sha256, row_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest, and row where ``row_col`` names a column.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays; among repeated rows with that id exactly one is kept, and each counts in group_size. A null
    id is the smallest. Other columns, whatever their names, are not read. An empty table gives no rows. ``row_col``
    is a long that is another in each row and the same whenever docs is read; it tells rows of one id apart.
    """
    spark = docs.sparkSession
    key, named = ("row", ["row"]) if row_col else ("id", [])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(row_col).alias("row") for _ in named])
    located = source.select("id", "text", F.input_file_name().alias("locator"), *named)
    tagged = located.mapInArrow(_digests(digest), "id long, locator string, digest string" + (", row long" if row_col else ""))
    tagged = written(tagged if row_col else tagged.withColumn("row", F.monotonically_increasing_id()))
    if not tagged.inputFiles() or tagged.isEmpty():
        return tagged.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", *named)
    state = keyed_state(tagged)
    found = tagged.join(state, "digest").select("id", "row", "digest", "keep", "group_size")
    # Full bytes of every hit: all texts of a digest are one text just when their smallest and largest agree.
    hits = found.where("group_size > 1").select(F.col(key).alias("hit")).distinct()
    several = found.where("group_size > 1").select("digest").distinct()
    suspects = source.select(F.col(key).alias("id"), "text").join(hits, F.col("id").eqNullSafe(F.col("hit")), "left_semi").mapInArrow(_digests(digest, "raw"), "id long, raw binary, digest string")
    texts = suspects.join(several, "digest", "left_semi")
    clash = written(texts.groupBy("digest").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("digest"))
    same = found.join(clash, "digest", "left_anti") if not clash.isEmpty() else found
    columns = ["id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "digest", *named]
    result = same.select(*columns)
    if clash.isEmpty():
        return result
    # Exact way for a digest shared by different texts: the text itself is the key. Repeated ids there share a text.
    own = texts.join(clash, "digest", "left_semi").select(F.col("digest").alias("d"), F.col("id").alias("own_id"), "raw").distinct()
    parts = found.join(clash, "digest", "left_semi").join(own, (F.col("d") == F.col("digest")) & F.col(key).eqNullSafe(F.col("own_id"))).select("id", "row", "digest", "raw")
    least = parts.groupBy("digest", "raw").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size"))
    return result.unionByName(parts.join(least, ["digest", "raw"]).select(*columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
h AS (SELECT doc_id, sha256(x) AS text_sha256 FROM t)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
