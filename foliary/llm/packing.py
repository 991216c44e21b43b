"""Best-fit packing (2): conflict-constrained best fit into token sequences of a fixed capacity.

Pieces enter in order of falling size. Open bins are ordered by residual capacity and carry bitmaps of their sources
and duplicate clusters; the search starts at the least residual that holds the piece and goes on to the successor
until a bin without conflict is found, which is then the tightest compatible one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import textops
from foliary.llm.common import table

#: Words of a sequence, documents of one source in a bin, documents that are packed together (one task's group).
CAPACITY, PER_SOURCE, GROUP = 2048, 2, 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece. sources and clusters: bit numbers; -1 conflicts with nothing. Ties go to the earlier piece and bin."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    residuals: list[tuple[int, int]] = []
    source_bits: list[list[int]] = []
    cluster_bits: list[int] = []
    out = [0] * len(sizes)
    for k in order:
        mine = 1 << sources[k] if sources[k] >= 0 else 0
        twin = 1 << clusters[k] if clusters[k] >= 0 else 0
        at = bisect_left(residuals, (sizes[k], -1))
        while at < len(residuals) and (cluster_bits[b := residuals[at][1]] & twin or source_bits[b][-1] & mine):
            at += 1
        if at < len(residuals):
            left, b = residuals.pop(at)
        else:
            left, b = capacity, len(cluster_bits)
            source_bits.append([0] * per_source)
            cluster_bits.append(0)
        for level in range(per_source):
            if not source_bits[b][level] & mine:
                source_bits[b][level] |= mine
                break
        cluster_bits[b] |= twin
        insort(residuals, (left - sizes[k], b))
        out[k] = b
    return out


def _measure(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textops.batches(source, "text"):
        data, at = textops.utf8(batch.column(2), lower=True)
        _, _, words = textops.word_spans(data, at)
        view = memoryview(data.tobytes())
        cluster = [int.from_bytes(hashlib.blake2b(view[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(words)), pa.array(cluster, pa.int64())], names=["id", "source", "size", "cluster"])


def _pack(capacity: int, per_source: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cluster", "id", "source", "size"], na_position="first").reset_index(drop=True)
        full = (rows["size"] // capacity).to_numpy()
        rest = (rows["size"] - full * capacity).to_numpy()
        loose = np.flatnonzero((rest > 0) | (full == 0))
        bit = {s: k for k, s in enumerate(rows["source"].dropna().unique())}
        sources = [bit.get(s, -1) for s in rows["source"].iloc[loose]]
        clusters = pd.factorize(rows["cluster"])[0][loose].tolist()
        bins = best_fit(rest[loose].tolist(), sources, clusters, capacity, per_source)
        held = np.concatenate([np.repeat(np.arange(len(rows)), full), loose])
        piece = np.concatenate([np.concatenate([np.arange(n) for n in full]) if len(full) else [], full[loose]]).astype(np.int64)
        size = np.concatenate([np.full(int(full.sum()), capacity), rest[loose]])
        place = np.concatenate([np.arange(int(full.sum())), np.array(bins, np.int64) + int(full.sum())])
        out = pd.DataFrame({"id": rows["id"].to_numpy()[held], "source": rows["source"].to_numpy()[held], "cluster": rows["cluster"].to_numpy()[held], "piece": piece, "size": size, "bin": place})
        out = out.sort_values(["bin", "id", "piece"], kind="stable")
        out["start"] = out.groupby("bin")["size"].cumsum() - out["size"]
        out["bin"] += int(rows["part"].iloc[0]) << 32
        out["id"] = out["id"].astype("Int64")
        return out

    return run


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, per_source: int = PER_SOURCE, group: int = GROUP) -> DataFrame:
    """One row per piece: id, source, cluster, piece, size, bin, start.

    Sizes are words of the whole text; a text of more than ``capacity`` words gives full pieces, which fill bins of
    their own, and a rest. A bin holds at most ``per_source`` pieces of a source and one of a duplicate cluster (texts
    equal but for A-Z case). Null and empty texts are pieces of size 0; a null source conflicts with nothing. Repeated
    rows are copies, so they part. A hash deals the documents into groups of about ``group``; each is packed by itself
    in one task, so a hot source or cluster spreads over all groups and no group grows with the table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    parts = max(1, -(-rows.count() // group))
    sized = rows.mapInArrow(_measure, "id long, source string, size long, cluster long").withColumn("part", F.expr(f"pmod(xxhash64(id, cluster, size), {parts})"))
    return sized.groupBy("part").applyInPandas(_pack(capacity, per_source), "id long, source string, cluster long, piece long, size long, bin long, start long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
