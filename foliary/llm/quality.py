"""Quality classifier (10): attention-based multiple-instance learning over passages.

Every passage of a text becomes a vector of shares (byte classes, neighbouring classes, word shapes, repetition);
a hidden layer encodes it, gated attention weighs the passages of a document, and the weighted mean is scored.
Weights are learned from document labels on a bounded sample; features and scores cover every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm import textops
from foliary.llm.common import table

#: Bytes of a passage; labelled rows that are learned from, and bytes of their whole texts, at most (half for each label).
PASSAGE, SAMPLE, SAMPLE_BYTES = 512, 6000, 1 << 25
HIDDEN, GATE, ROUNDS, SEED = 24, 12, 160, 7

_CLASS = np.full(256, 9, np.uint8)  # 9: other control and symbol bytes
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32]] = 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_CLASS[[44, 46, 59, 58]] = 5
_CLASS[[33, 63]] = 6
_CLASS[[35, 36, 37, 38, 42, 64, 124, 95, 126, 94, 43, 61, 60, 62, 92]] = 7
_CLASS[[39, 34, 40, 41, 45, 47, 91, 93, 123, 125]] = 8
_CLASS[128:] = 0
CLASSES = 10
FEATURES = CLASSES + CLASSES * CLASSES + 4


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a column's texts, and the passage offsets of its documents (one passage at least)."""
    data, at = textops.utf8(column)
    lengths = np.diff(at)
    n = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(total) - first[doc]
    starts = at[:-1][doc] + within * PASSAGE
    sizes = np.minimum(PASSAGE, at[1:][doc] - starts)
    owner = np.repeat(np.arange(total), sizes)
    kind = _CLASS[data].astype(np.int64)
    out = np.zeros((total, FEATURES), np.float32)
    share = 1 / np.maximum(sizes, 1)[:, None]
    out[:, :CLASSES] = np.bincount(owner * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) * share
    if len(data) > 1:
        same = owner[1:] == owner[:-1]
        pair = owner[1:] * CLASSES**2 + kind[:-1] * CLASSES + kind[1:]
        out[:, CLASSES : CLASSES + CLASSES**2] = np.bincount(pair[same], minlength=total * CLASSES**2).reshape(total, CLASSES**2) * share
    s, e, _ = textops.word_spans(data, at)
    if len(s):
        hashes = textops.span_hashes(data, s, e)
        place = owner[s]
        words = np.bincount(place, minlength=total)
        order = np.lexsort((hashes, place))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (place[order][1:] != place[order][:-1])
        distinct = np.bincount(place[order][new], minlength=total)
        again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (place[1:] == place[:-1])])
        out[:, -4] = distinct / np.maximum(words, 1)
        out[:, -3] = np.bincount(place, again, total) / np.maximum(words, 1)
        out[:, -2] = np.bincount(place, e - s, total) / np.maximum(words, 1) / 10
    out[:, -1] = np.log1p(sizes) / 7
    return out, first


class GatedAttention:
    """score = sigmoid(w . sum_k a_k h_k + c); h = tanh(x E + e); a = softmax(u . (tanh(h V) * sigmoid(h G)))."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, mean: np.ndarray, scale: np.ndarray, seed: int = SEED) -> GatedAttention:
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        w = {"E": init(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "G": init(HIDDEN, GATE), "u": init(GATE, 1)[:, 0], "w": init(HIDDEN, 1)[:, 0], "c": np.zeros(1)}
        return cls(w | {"mean": mean, "scale": scale})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        z = (x - w["mean"]) / w["scale"]
        h = np.tanh(z @ w["E"] + w["e"])
        v, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["G"])))
        s = (v * g) @ w["u"]
        counts = np.diff(first)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first[:-1]), counts))
        a = s / np.repeat(np.add.reduceat(s, first[:-1]), counts)
        m = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"z": z, "h": h, "v": v, "g": g, "a": a, "m": m, "p": 1 / (1 + np.exp(-np.clip(m @ w["w"] + w["c"], -30, 30)))}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["p"]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, rate: float = 0.01, decay: float = 1e-4) -> None:
        """Full-batch Adam on weighted cross entropy. Deterministic for the same rows in the same order."""
        names = ["E", "e", "V", "G", "u", "w", "c"]
        one, two = {k: np.zeros_like(self.w[k]) for k in names}, {k: np.zeros_like(self.w[k]) for k in names}
        counts = np.diff(first)
        for t in range(1, rounds + 1):
            o = self.forward(x, first)
            dl = (o["p"] - y) * weight
            grad = {"w": o["m"].T @ dl, "c": dl.sum(keepdims=True)}
            dm = np.repeat(dl, counts)[:, None] * self.w["w"]
            da = (dm * o["h"]).sum(1)
            ds = o["a"] * (da - np.repeat(np.add.reduceat(o["a"] * da, first[:-1]), counts))
            grad["u"] = (o["v"] * o["g"]).T @ ds
            dv = ds[:, None] * self.w["u"] * o["g"] * (1 - o["v"] ** 2)
            dg = ds[:, None] * self.w["u"] * o["v"] * o["g"] * (1 - o["g"])
            grad["V"], grad["G"] = o["h"].T @ dv, o["h"].T @ dg
            dh = (o["a"][:, None] * dm + dv @ self.w["V"].T + dg @ self.w["G"].T) * (1 - o["h"] ** 2)
            grad["E"], grad["e"] = o["z"].T @ dh, dh.sum(0)
            for k in names:
                g = grad[k] + decay * self.w[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                self.w[k] = self.w[k] - rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> GatedAttention:
    """Fits on whole texts of at most ``sample`` labelled rows that are not held out, half of each label, in the order of
    a hash of the id, as many as have ``sample_bytes`` together. A text of over 1/128 of ``sample_bytes`` (256 KB) is
    passed over, so that no single one takes its class's room.

    Only label 0 and 1 count. Every passage of a sampled text is learned from. Without both labels the model scores
    every text the share of label 1 (0.5 without labels).
    """
    known = labels.where(~held_out(id_col)).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    picked = known.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(sample // 2).unionByName(known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(sample // 2))
    picked = picked.dropDuplicates(["id"])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most ``sample`` ids: a bounded side, so it is broadcast and the texts stay where they are.
    sizes = texts.join(F.broadcast(picked), "id").select("id", "y", (F.coalesce(F.octet_length("text"), F.lit(0)) + PASSAGE).cast("long").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    fitting = sizes.groupBy("id", "y").agg(F.sum("size").alias("size")).where(F.col("size") <= sample_bytes // 128).withColumn("upto", upto).where(F.col("upto") <= sample_bytes // 2).select("id", "y")

    def features(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.batches(source):
            x, first = passages(batch.column(2))
            rows = [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "y", "x"])

    chosen = texts.join(F.broadcast(fitting), "id").select("id", "y", "text")
    rows = sorted(chosen.mapInArrow(features, "id long, y int, x binary").toLocalIterator(), key=lambda r: (r["id"], r["x"]))
    y = np.array([r["y"] for r in rows], np.float64)
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES) for r in rows]
    if not len(y) or y.min() == y.max():
        model = GatedAttention.fresh(np.zeros(FEATURES), np.ones(FEATURES))
        model.w["w"][:] = 0
        model.w["c"][:] = 0 if not len(y) else np.log((y.mean() + 0.01) / (1.01 - y.mean()))
        return model
    x = np.concatenate(parts).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    model = GatedAttention.fresh(x.mean(0), x.std(0) + 0.01)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    model.fit(x, first, y, weight)
    return model


def quality_scores(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted for every row; null and empty texts are one empty passage. Weights are a few KB."""
    weights = {k: np.asarray(v, np.float32) for k, v in model.w.items()}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = GatedAttention(weights)
        for batch in textops.batches(source, most=1 << 20):
            p = held.score(*passages(batch.column(2))).astype(np.float64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int")


def quality_filter(docs: DataFrame, model: GatedAttention, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores at least ``threshold``, all columns as they are; no row moves."""
    weights = {k: np.asarray(v, np.float32) for k, v in model.w.items()}
    at = docs.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = GatedAttention(weights)
        for batch in textops.batches(source, text_col, 1 << 20):
            yield batch.filter(pa.array(held.score(*passages(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, model).withColumnRenamed("id", "doc_id")
