"""A small logistic regression and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import written


#: Hashes are compared with a share of this range.
RANGE = 1 << 30


def within(key: Column, share: Column | float) -> Column:
    """Whether the hash of ``key`` lies in the first ``share`` of its range: the same rows on every run."""
    return F.pmod(F.xxhash64(key, F.lit(RANGE)), F.lit(RANGE)) < share * F.lit(float(RANGE))


def _shares(rows: DataFrame, most: int) -> Column:
    """Per label the share of ``rows`` that leaves about ``most``; two counts reach the driver."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.lit(1.0)
    for label in (0, 1):
        share = F.when(F.col("label") == label, min(1.0, most / max(1, counts.get(label, 0)))).otherwise(share)
    return share


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, text, h) of distinct labelled texts, about ``most`` of each class (less than its square root more or less), in the shared folder.

    Ids are chosen by a bound on their hash, which counts per class set, so no
    class is ordered or gathered; where ids repeat, texts are chosen again in
    the same way.  Null ids, labels and texts are left out; equal texts of a
    class count once.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    chosen = rows.filter(within(F.col("doc_id"), _shares(rows, most)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    # About 2 * most rows: small enough to broadcast.
    found = texts.join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("text").alias("h"))
    found = written(found.dropDuplicates(["label", "h"]), "labelled")
    return found.filter(within(F.col("h"), _shares(found, most)))


class Logistic:
    """Weights over standardised features; ``fit`` takes Newton steps with a small ridge."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
        if not len(y) or y.min() == y.max():  # one class or none: its share, smoothed
            share = (y.sum() + 0.5) / (len(y) + 1)
            return cls(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), float(np.log(share / (1 - share))))
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + penalty * w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), grad)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        return cls(mean, scale, w[:-1], float(w[-1]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
