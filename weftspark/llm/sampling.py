"""Bounded, repeatable samples of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.language import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int) -> tuple[list[tuple[bytes, int]], tuple[int, int]]:
    """Whole texts and labels of at most per_class documents of each class 0 and 1, those with the smallest hash of the id,
    and the number of rows that either class has to offer.

    Held-out ids and rows without id or label are never among them; of an id that repeats one row is taken.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = [usable.filter(F.col("label") == k).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    few = chosen[0].union(chosen[1])  # 2 x per_class rows: small enough to broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    rows = {(r["doc_id"], r["label"]): r["text"] for r in texts.toLocalIterator()}
    order = sorted(rows, key=lambda k: (k[0] * 2654435761 % 4294967296, k))
    offered = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("label in (0, 1)").collect()}
    return [((rows[k] or "").encode("utf-8"), k[1]) for k in order], (offered.get(0, 0), offered.get(1, 0))


def logistic(features: np.ndarray, target: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last is the intercept) of a logistic regression by Newton steps."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[(features - mean) / scale, np.ones(len(features))]
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) / len(x) + ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights = weights - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, weights
