"""Centroid clustering (12): Lloyd rounds with Yinyang grouping.

The centroids are put into groups once. Each vector keeps its centroid, an upper bound of the distance to it and one
lower bound for each group (of the nearest other centroid there). After a round the bounds move by how far centroids
moved: a vector whose upper bound is under all its lower bounds stays without a distance (global filter); else its
upper bound is made exact, and only groups whose lower bound doesn't exceed it are scanned, exactly, in whole numbers.

A round is one pass over a written table: a row carries its vector and bounds, and each batch adds a row with its sums
by cluster, so no vector is shuffled and the driver gets sums of a few KB a task and round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import remove, table, written

#: Centroids to a group, rows worked on at once, size that 256-fold components stay under so that distances fit a long.
GROUP, ROWS, MOST = 10, 8192, 1 << 27
STATE = "id long, v binary, cluster int, upper double, lower binary, sums binary"
#: Share by which float bounds are widened; more than rounding takes from sums of this many terms.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, width: int, scale: int) -> DataFrame:
    """(id, v array of long) of the vectors that take part."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == width)).where(fine)
    size = F.array_max(F.transform(vec_col, lambda x: F.abs(x.cast("double") * scale)))
    v = F.when(size < MOST, F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(v, F.raise_error(F.lit(f"a component times {scale} is {MOST} or more: distances would not fit"))).alias("v"))


def groups_of(centroids: np.ndarray, size: int = GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few Lloyd rounds over the centroids themselves, from evenly spaced ones."""
    t = max(1, -(-len(centroids) // size))
    middle = centroids[np.linspace(0, len(centroids) - 1, t).astype(int)].astype(np.float64)
    for _ in range(rounds):
        own = ((centroids[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(t):
            if (own == g).any():
                middle[g] = centroids[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]  # no group is empty


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c, as whole numbers."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:  # all partial sums are whole numbers that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


class Round:
    """One assignment of vectors to centroids, given how far each centroid has moved since the bounds were set."""

    def __init__(self, centroids: np.ndarray, groups: np.ndarray, before: np.ndarray | None):
        self.c, self.groups, self.t = centroids, groups, int(groups.max()) + 1
        self.drift = np.sqrt(((centroids - (centroids if before is None else before)).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        self.far = np.array([self.drift[groups == g].max(initial=0) for g in range(self.t)])
        self.members = [np.flatnonzero(groups == g) for g in range(self.t)]
        self.scanned = 0

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New centroid, upper bound and lower bounds by group. own -1: not assigned yet."""
        own, fresh = own.copy(), own < 0
        upper = np.where(fresh, np.inf, upper + self.drift[own])
        lower = np.where(fresh[:, None], -np.inf, lower - self.far[None])
        # Global filter; ties must be looked at, for the smaller number wins them.
        at = np.flatnonzero(lower.min(1) <= upper * (1 + SLACK))
        exact = np.full(len(x), -1, np.int64)
        set_before = at[~fresh[at]]
        exact[set_before] = ((x[set_before] - self.c[own[set_before]]) ** 2).sum(1)
        upper[set_before] = np.sqrt(exact[set_before])
        at = at[lower[at].min(1) <= upper[at] * (1 + SLACK)]
        if not len(at):
            return own, upper, lower
        # Group filter: only groups that may hold a nearer (or equal) centroid are scanned.
        best = np.where(fresh[at], np.iinfo(np.int64).max, exact[at])
        new = np.where(fresh[at], len(self.c), own[at])
        asked = lower[at] <= upper[at][:, None] * (1 + SLACK)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(asked[:, g])
            d = squared(x[at[rows]], self.c[members])
            self.scanned += d.size
            found.append((rows, d))
            k = d.argmin(1)  # members rise, so the first least one has the smallest number
            near, number = d[np.arange(len(rows)), k], members[k]
            better = (near < best[rows]) | (near == best[rows]) & (number < new[rows])
            best[rows[better]], new[rows[better]] = near[better], number[better]
        for g, (rows, d) in enumerate(found):
            others = np.where(self.members[g][None] == new[rows][:, None], np.inf, np.sqrt(d))
            lower[at[rows], g] = others.min(1, initial=np.inf)
        # A centroid that was left lies in a group that may not have been scanned: it bounds that group now.
        left = np.flatnonzero((new != own[at]) & ~fresh[at])
        g = self.groups[own[at[left]]]
        lower[at[left], g] = np.minimum(lower[at[left], g], np.sqrt(exact[at[left]]))
        own[at], upper[at] = new, np.sqrt(best)
        return own, upper, lower


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """A row for each centroid: count, then the sums of its vectors' components."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    order = np.argsort(own, kind="stable")
    start = np.flatnonzero(np.diff(own[order], prepend=-1))
    if len(start):
        names = own[order][start]
        out[names, 0] = np.diff(np.append(start, len(order)))
        out[names, 1:] = np.add.reduceat(x[order], start)
    return out


def _pass(step: Round, width: int):
    """Batches of STATE to batches of STATE, and one more row with the sums of each batch."""
    k, t = len(step.c), step.t

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for whole in source:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                n = batch.num_rows
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(n, width).astype(np.int64)
                own = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                lower = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f8").reshape(n, -1) if (own >= 0).any() else np.zeros((n, t))
                own, upper, lower = step.assign(x, own, batch.column(3).to_numpy(zero_copy_only=False), lower)
                total += _sums(x, own, k)
                packed = [r.tobytes() for r in lower.astype("<f8")]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(upper), pa.array(packed, pa.binary()), pa.nulls(n, pa.binary())], names=["id", "v", "cluster", "upper", "lower", "sums"])
        if total.any():
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["id", "v", "cluster", "upper", "lower", "sums"])

    return run


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v list) to STATE before any assignment."""
    for batch in source:
        n = batch.num_rows
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(n, -1) if n else np.zeros((0, 1), "<i4")
        rows = [r.tobytes() for r in values]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary()), pa.array(np.full(n, -1), pa.int32()), pa.array(np.zeros(n)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["id", "v", "cluster", "upper", "lower", "sums"])


def _added(state: DataFrame, k: int, width: int) -> np.ndarray:
    """Counts and sums of all clusters. Tasks' rows are added up in Spark, so the driver gets one row."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (width + 1), np.int64)
        for batch in source:
            for row in batch.column(0).to_pylist():
                total += np.frombuffer(row, np.int64)
        yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "n"])

    each = state.where("sums is not null").select("sums").mapInArrow(run, "at int, n long")
    out = np.zeros(k * (width + 1), np.int64)
    for r in each.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(k, width + 1)


def first_centroids(rows: DataFrame, k: int, salt: str = "2") -> np.ndarray:
    """The k vectors with the smallest lowercase-hex sha256 of ``salt:id``; ties by components, null ids after all others."""
    by = F.sha2(F.concat_ws(":", F.lit(salt), F.col("id").cast("string")), 256)
    found = rows.select(F.col("id").isNull().alias("none"), by.alias("by"), "v").orderBy("none", "by", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def yinyang(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", group: int = GROUP) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) for each vector that takes part, centroids): Lloyd's rounds, then one more assignment.

    Components become floor(scale * x). Vectors that are null, of another width or with null or non-finite components
    take no part; repeated vectors, repeated ids and null ids do, each row by itself. Ties go to the smaller centroid
    number; an empty centroid stays where it is; means are exact floors. With fewer than k vectors there are as many
    centroids as vectors; without any the result is empty. A component whose scale-fold reaches 2**27 is an error.
    Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vec_col, width, scale)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, width), np.int64)
    groups, before = groups_of(centroids, group), None
    state = rows.mapInArrow(_packed, STATE)
    held: DataFrame | None = None
    for _ in range(rounds):
        state = written(state.where("sums is null").mapInArrow(_pass(Round(centroids, groups, before), width), STATE))
        sums = _added(state, len(centroids), width)
        before, some = centroids, sums[:, 0] > 0
        centroids = centroids.copy()
        centroids[some] = sums[some, 1:] // sums[some, :1]  # whole numbers' // is the floor
        if held is not None:
            remove(held)
        held = state
    last = Round(centroids, groups, before)

    def finished(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pass(last, width)(source):
            if batch.column(5).null_count:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(batch.num_rows, width).astype(np.int64)
                own = batch.column(2).to_numpy(zero_copy_only=False)
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(((x - centroids[own]) ** 2).sum(1))], names=["id", "cluster", "distance"])

    found = written(state.where("sums is null").mapInArrow(finished, "id long, cluster int, distance long"))
    if held is not None:
        remove(held)
    return found, centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = yinyang(table(spark, sf_dir, "embeddings"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = found.agg(F.sum("distance").alias("inertia"))
    # As many rows as there are centroids, 40 at most.
    named = F.broadcast(inertia.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").crossJoin(total))
    return found.join(named, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds written out one after another, every vector against every centroid."""
    near = "SELECT id, v, arg_min(n, struct_pack(d := d, n := n)) AS cluster, min(d) AS distance FROM (SELECT id, v, n, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x, c{0}) GROUP BY id, v"
    parts = [
        "x AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || id)) - 1 AS n, v AS c FROM x ORDER BY sha256('2:' || id) LIMIT {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        parts.append(f"s{r} AS (SELECT cluster, i, sum(y) AS s, count(*) AS m FROM (SELECT cluster, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)")
        parts.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cluster)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.n, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.n = m{r}.cluster)")
    parts.append(f"z AS MATERIALIZED ({near.format(rounds)})")
    return f"WITH {', '.join(parts)} SELECT id AS vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON n = cluster"


OP12_SQL = _lloyd_sql()
