"""Checkpoints of jobs in a versioned table: items idle, running, success or error, of which only what hasn't succeeded
runs again; and a sink for streams that writes each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.sources.versioned import VersionedTable

ITEMS = "bucket int, job string, item string, state string, attempts int, output string, error string"
INTERRUPTED, ERROR_CHARS, BUCKETS = "interrupted: running is idle again", 1000, 16


class Checkpoints:
    """Items are named by (job, item). A change rewrites the buckets of the jobs it touches, in one version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path, "bucket", ITEMS)

    def items(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).drop("v", "bucket")

    def opened(self, items: DataFrame) -> None:
        """Before a run: items (job, item) that aren't known yet are added as idle; running ones, which a crash has left,
        are idle again; all others stay as they are, outputs included."""
        held = self.items()
        named = items.select("job", "item").distinct()
        fresh = named.join(held, ["job", "item"], "left_anti").select("job", "item", F.lit("idle").alias("state"), F.lit(0).alias("attempts"), _none("output"), _none("error"))
        crashed = held.where("state = 'running'").withColumns({"state": F.lit("idle"), "error": F.lit(INTERRUPTED)})
        self._put(fresh.unionByName(crashed))

    def pending(self) -> DataFrame:
        return self.items().where("state <> 'success'")

    def run(self, work: Callable[[DataFrame], DataFrame], jobs: DataFrame | None = None) -> None:
        """work gets the pending items (job, item) and returns (job, item, output, error), error null for success. They are
        running while it works; if it dies, the next ``opened`` finds them so. An item that it leaves out stays running."""
        asked = self.pending() if jobs is None else self.pending().join(jobs, "job", "left_semi")
        begun = asked.withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1, "error": _none("error")})
        before = self.table.manifest()["version"]
        self._put(begun)
        if self.table.manifest()["version"] == before:
            return
        running = self.items(self.table.manifest()["version"]).where("state = 'running'")
        done = work(running.select("job", "item")).select("job", "item", F.col("output").alias("o"), F.substring("error", 1, ERROR_CHARS).alias("e"))
        ended = running.join(done, ["job", "item"]).select("job", "item", F.when(F.col("e").isNull(), "success").otherwise("error").alias("state"), "attempts", F.when(F.col("e").isNull(), F.col("o")).alias("output"), F.col("e").alias("error"))
        self._put(ended)

    def reset(self, items: DataFrame) -> None:
        """Items (job, item) are idle again without error and output."""
        hit = self.items().join(items.select("job", "item").distinct(), ["job", "item"], "left_semi")
        self._put(hit.withColumns({"state": F.lit("idle"), "output": _none("output"), "error": _none("error")}))

    def states(self) -> DataFrame:
        """(job, state): running before all-success before error before idle."""
        some = lambda s: F.bool_or(F.col("state") == s)
        state = F.when(some("running"), "running").when(F.bool_and(F.col("state") == "success"), "success").when(some("error"), "error").otherwise("idle")
        return self.items().groupBy("job").agg(state.alias("state"))

    def _put(self, rows: DataFrame) -> None:
        if not rows.isEmpty():
            bucket = F.pmod(F.xxhash64("job"), F.lit(BUCKETS)).cast("int").alias("bucket")
            self.table.merge(rows.select(bucket, "job", "item", "state", "attempts", "output", "error"), ["bucket", "job", "item"])


def _none(name: str):
    return F.lit(None).cast("string").alias(name)


def once(table: VersionedTable, stream: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends each batch of the stream to the table; a batch that is played again after a failure,
    which has the number it had before, changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        table.append(batch, (stream, number))

    return put
