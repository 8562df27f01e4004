"""Labelled rows to fit on, and small models fitted from them on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows to fit on at most: those whose ids have the smallest hashes. Fitting needs no more at any size of the corpus.
FIT_ROWS = 8_000
#: Bytes of their texts at most: a text that would go beyond is left out, whole, and others are still tried.
FIT_BYTES = 128 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> tuple[list[str], np.ndarray]:
    """(texts, labels 0/1) of at most `rows` labelled documents outside the held-out fold (crc32 of doc_id as text mod folds),
    of most_bytes together at most. The driver holds no more than those.

    Null labels and null ids are left out. Of repeated labels of a document the largest counts, of repeated documents
    the smallest text; a null text is empty.
    """
    mine = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (common.crc_of_id() % folds != held_out))
    chosen = mine.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # the sample is bounded by `rows`
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))
    found, path = common.write_work(found, "labelled")
    sizes = found.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    taken, used = [], 0
    for doc_id, n in zip(sizes.column("doc_id").to_pylist(), sizes.column("n").to_pylist()):
        if used + n <= most_bytes:
            taken.append(doc_id)
            used += n
    if len(taken) < sizes.num_rows:
        found = found.filter(F.col("doc_id").isin(taken))
    sample = found.toArrow().sort_by("doc_id")
    common.drop_folder(docs.sparkSession, path)
    return sample.column("text").to_pylist(), sample.column("y").to_numpy().astype(np.int64)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant's) of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
