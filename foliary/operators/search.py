"""Full-text search: trigram postings with BM25, containment below three characters, candidate groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


#: Characters of text whose grams are counted at once (one text at least).
CHARS = 1 << 19


def _counted(points: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end as code points, and how long each is: (text, gram's three points, how often) of what occurs."""
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    kinds = np.flatnonzero(seen)
    k, n = len(kinds), len(sizes)
    if n > 1 and k**3 * n >= 1 << 63:
        for i, (end, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
            for _, grams, tf in _counted(points[end - size : end], sizes[i : i + 1]):
                yield np.full(len(tf), i), grams, tf
        return
    rank = np.cumsum(seen, dtype=np.int64)[points] - 1
    text = np.repeat(np.arange(n), sizes)
    whole = text[2:] == text[:-2]  # not over a text's end
    keys, tf = np.unique((((text[:-2] * k + rank[:-2]) * k + rank[1:-1]) * k + rank[2:])[whole], return_counts=True)
    yield keys // k**3, kinds[np.stack([keys // k**2 % k, keys // k % k, keys % k], 1)], tf


def _grams(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        size = batch.column(2).to_numpy() + 2  # texts under three characters aren't here
        ends = np.cumsum(size)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHARS, "right")))
            points = np.frombuffer("".join(batch.column(1).slice(a, b - a).to_pylist()).encode("utf-32-le"), "<u4")
            for text, grams, tf in _counted(points, size[a:b]):
                said = grams.astype("<u4").tobytes().decode("utf-32-le")
                text = pa.array(text + a)
                for i in range(0, len(tf), 1 << 16):
                    some = text.slice(i, 1 << 16)
                    yield pa.record_batch([pa.array([said[j : j + 3] for j in range(3 * i, min(len(said), 3 * (i + (1 << 16))), 3)], pa.string()), batch.column(0).take(some), batch.column(2).take(some), pa.array(tf[i : i + (1 << 16)])], names=["gram", "id", "doc_len", "tf"])
            a = b


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, id, doc_len, tf): how often each distinct trigram (lower case) occurs.

    A text's grams are counted where it is read, so only distinct ones become rows; rows of ids that occur again are
    added up in a second step, which others don't need."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), low.alias("text"), (F.length(low) - 2).alias("doc_len"))
    form = StructType([StructField("gram", StringType()), rows.schema["id"], StructField("doc_len", IntegerType()), StructField("tf", LongType())])
    found = rows.where("doc_len > 0").mapInArrow(_grams, form)
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("gram", "id", "doc_len").agg(F.sum("tf").alias("tf"))


def bm25(docs: DataFrame, id_col: str, text_col: str, phrase: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, rank) of texts that contain the phrase, without case; less is better. Under three characters all ranks are 0.
    Hits are counted by where they start, so overlapping ones count each.

    A scan of all texts, for a table without an index (phrase_index has one): documents are filtered first and the
    corpus's figures are two sums, so nothing is exploded.
    """
    low, term = F.lower(F.coalesce(F.col(text_col), F.lit(""))), phrase.lower()
    if not term.strip():
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("rank")).limit(0)
    hit = F.contains(low, F.lit(term))
    if len(term) < 3:
        return docs.where(hit).select(F.col(id_col).alias("id"), F.lit(0.0).alias("rank"))
    size = F.greatest(F.length(low) - 2, F.lit(0))
    figures = docs.agg(F.count("*").alias("n"), F.count_if(hit).alias("df"), F.avg(size).alias("mean"))
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    tf = F.regexp_count(low, F.lit(f"(?={quoted})")).cast("double")
    found = docs.where(hit).select(F.col(id_col).alias("id"), tf.alias("tf"), size.alias("size"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    rank = -idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return found.crossJoin(F.broadcast(figures)).select("id", rank.alias("rank"))  # one row of figures


def candidate_groups(hits: DataFrame, name: str, rank: str) -> DataFrame:
    """Hits by name without page suffix; best rank first."""
    base = F.regexp_replace(name, r"_[Pp]\d+$", "")
    return hits.groupBy(base.alias("name")).agg(F.count("*").alias("items"), F.min(rank).alias("best"))


def upserted(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Postings (gram, id, tf, doc_len) after documents (id, text) were added or changed and others removed (id)."""
    gone = added.select("id").unionByName(removed.select("id")).distinct()
    return index.join(gone, "id", "left_anti").select("gram", "id", "tf", "doc_len").unionByName(postings(added, "id", "text").select("gram", "id", "tf", "doc_len"))


def rebuilt(docs: DataFrame) -> DataFrame:
    """Postings of all live documents (id, text, deleted_at)."""
    return postings(docs.where(F.col("deleted_at").isNull()), "id", "text").select("gram", "id", "tf", "doc_len")


def best(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The best ranks first (less is better), ties by id."""
    return found.orderBy("rank", "id").offset(offset).limit(limit)


def candidates(hits: DataFrame, materials: DataFrame, project) -> DataFrame:
    """Search hits (id, rank) with the live materials (id, project_id ..) that a project may see."""
    mine = materials.where(F.col("deleted_at").isNull() & (F.col("project_id").isNull() | (F.col("project_id") == F.lit(project))))
    return hits.join(mine, "id")
