"""Labelled samples and isotonic calibration, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc

#: Most labelled documents that a classifier is fitted on; ids and labels of that many rows are broadcast.
TRAIN_ROWS = 200_000
BINS = 2048


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label, fold) of documents outside the held-out remainder, at most ``bound`` of them by a hash of the id.

    Null labels and ids are left out; of several labels of one document the largest counts. ``fold`` 0 to 4 sets rows
    apart for calibration.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    own = own.where(id_crc() % modulus != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(5)).cast("int"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(own), "doc_id").select("doc_id", "text", "label", "fold")


def pool(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the non-decreasing means that fit total/weight best; bins without weight take a neighbour's."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(weight > 0):
        blocks.append([weight[i], total[i], i])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, t, first = blocks[-1][0], blocks[-1][1], blocks[-2][2]
            blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + t, first]
    out = np.zeros(len(weight))
    for k, (w, t, first) in enumerate(blocks):
        out[int(first) if k else 0 : int(blocks[k + 1][2]) if k + 1 < len(blocks) else len(out)] = t / w
    return out


class Isotonic:
    """A calibration curve over equal bins of a raw score between two bounds."""

    def __init__(self, low: float, high: float, weight: np.ndarray, total: np.ndarray, prior: float = 1.0):
        self.low, self.high = low, high
        base = total.sum() / max(weight.sum(), 1e-9)
        seen = weight > 0
        # a little weight of the base rate keeps a pure bin from claiming certainty
        self.value = pool(weight, total)
        n = np.where(seen, weight, 0)
        ids = np.concatenate([[0], np.cumsum(np.diff(self.value) != 0)]) if len(self.value) else np.zeros(0, int)
        size = np.bincount(ids, n)[ids] if len(ids) else n
        self.value = np.maximum.accumulate((self.value * size + base * prior) / np.maximum(size + prior, 1e-9))

    @staticmethod
    def bins(raw: np.ndarray, low: float, high: float, n: int = BINS) -> np.ndarray:
        return np.clip(((raw - low) / max(high - low, 1e-12) * n).astype(np.int64), 0, n - 1)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        n = len(self.value)
        x = np.clip((raw - self.low) / max(self.high - self.low, 1e-12) * n - 0.5, 0, n - 1)
        return np.clip(np.interp(x, np.arange(n), self.value), 0.0, 1.0)
