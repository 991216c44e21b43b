"""Exact top-k search (6): norm-sorted inner products with SVD-rotated partial sums and Cauchy-Schwarz bounds.

Vectors lie in blocks of falling length. The longest block gives each query a score to beat; in the other blocks a
vector is left aside when its length times the query's, or the exact sum over the leading rotated dimensions plus
the product of the two residual lengths, can't reach it. What remains is scored in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import table, written

#: Rows of a block of vectors and of queries, vectors that the rotation is fitted on, leading dimensions.
BLOCK, QUERIES, SAMPLE, LEADING = 4096, 1024, 4096, 16


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array of long, norm2) of the vectors that take part: not null, all components finite, id not null."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine)
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, in that order."""
    if len(scores) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


def _search(width: int, k: int, rotation: np.ndarray):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values(["norm2", "id"], ascending=[False, True])
            x, q = matrix(vectors["v"], width), matrix(queries["v"], width)
            ids = vectors["id"].to_numpy()
            xr, qr = x @ rotation, q @ rotation
            lead = min(LEADING, width)
            tail_x, tail_q = np.sqrt((xr[:, lead:] ** 2).sum(1)), np.sqrt((qr[:, lead:] ** 2).sum(1))
            long_x, long_q = np.sqrt(vectors["norm2"].to_numpy()), np.sqrt(queries["norm2"].to_numpy())
            beat = queries["beat"].to_numpy(np.float64, na_value=-np.inf)
            exact = np.abs(q).max() * np.abs(x).max() * width < 2**52
            for i, own in enumerate(queries["id"]):
                slack = 1e-9 * (1 + long_q[i] * (long_x[0] if len(long_x) else 0))
                n = len(x) if beat[i] == -np.inf or long_q[i] == 0 else int(np.searchsorted(-long_x * long_q[i], -(beat[i] - slack), "right"))
                bound = xr[:n, :lead] @ qr[i, :lead] + tail_x[:n] * tail_q[i]
                near = np.flatnonzero((bound >= beat[i] - slack) & (ids[:n] != own))
                if not len(near):
                    continue
                scores = (x[near].astype(np.float64) @ q[i].astype(np.float64)).astype(np.int64) if exact else x[near] @ q[i]
                out += [(int(own), int(ids[near[j]]), int(scores[j])) for j in best(ids[near], scores, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every``, the k others of highest score.

    Score: inner product of floor(scale * component). Ties go to smaller ids. Vectors null or with null or non-finite
    components take no part, nor do null ids; in a shorter vector, and an empty one, the missing components count as 0.
    Each row of a repeated id is a candidate, though not of a query with that id; rows of a repeated query id share one
    list, the best of all their scores. Fewer than k others: all of them. Scores must fit a long.
    """
    rows = written(whole_vectors(vectors, id_col, vec_col, scale))
    n, width = rows.agg(F.count("*"), F.greatest(F.coalesce(F.max(F.size("v")), F.lit(1)), F.lit(1))).first()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()]
    sampled = matrix(pd.Series(sample, dtype=object), width).astype(np.float64)
    rotation = np.linalg.svd(sampled, full_matrices=True)[2].T if len(sample) and np.isfinite(sampled).all() else np.eye(width)
    blocks = max(1, -(-n // BLOCK))
    ranged = written(rows.repartitionByRange(blocks, F.desc("norm2"), "id").withColumn("block", F.spark_partition_id()))
    queries = ranged.where(F.col("id") % every == 0).drop("block")
    parts = max(1, -(-queries.count() // QUERIES))
    last = ranged.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    queries = written(queries.withColumn("part", F.expr(f"pmod(xxhash64(id), {parts})")))
    spread = ranged.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def scored(asked: DataFrame, within: DataFrame) -> DataFrame:
        return asked.groupBy("part", "block").cogroup(within.groupBy("part", "block")).applyInPandas(_search(width, k, rotation), "query_id long, vec_id long, score long")

    first = written(scored(queries.withColumn("block", F.lit(0)).withColumn("beat", F.lit(None).cast("double")), spread.where("block = 0")))
    beat = first.groupBy("query_id").agg(F.min("score").alias("beat"), F.count("*").alias("n")).where(f"n >= {k}").select(F.col("query_id").alias("id"), F.col("beat").cast("double").alias("beat"))
    rest = queries.join(beat, "id", "left").withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(last)))) if last else None
    found = first.unionByName(scored(rest, spread.where("block > 0"))) if last else first
    # Each block has given k rows of a query at most, so a query's list has a bound by block.
    ordered = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k).alias("top"))
    return ordered.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.less")).alias("score"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
