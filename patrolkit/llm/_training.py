"""Bounded samples of labelled texts, and a small logistic fit on the driver."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def bounded_sample(rows: DataFrame, docs: DataFrame, label: str, per_label: int, max_bytes: int, seed: int = 11) -> tuple[list[tuple[str, object]], dict]:
    """About ``per_label`` texts of each label, as ``(text, label)`` in an order that the ids decide, and all labels' counts.

    ``rows`` holds (doc_id, label), ``docs`` (doc_id, text). Ids with two labels and texts that are null or longer than
    ``max_bytes`` are left out, so the sample fits the driver whatever the tables' size: the counts by label come first,
    and a hash of the id then keeps ``per_label / count`` of a label's ids (all of them when they are fewer).
    """
    clean = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    single = clean.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in single.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], {}
    spread = 1 << 30
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(spread))
    kept = F.lit(False)
    for value, n in counts.items():
        kept = kept | ((F.col("label") == F.lit(value)) & (draw < F.lit(int(spread * min(1.0, per_label / n)))))
    chosen = single.where(kept).withColumn("draw", draw)  # about per_label rows a label: bounded, so broadcast
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "text")
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("draw").alias("draw"))
    got = [(r["draw"], r["doc_id"], r["text"], r["label"]) for r in joined.collect()]
    return without_copies([(text, value) for _, _, text, value in sorted(got, key=lambda r: r[:2])]), counts


#: Least hashes of a text's words that stand for it when a sample's near copies are found, and how many kept texts a
#: hash may point to before it counts as a common word's.
SKETCH, COMMON = 24, 50


def without_copies(sample: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """The sample without texts whose sketch agrees with an earlier one's of the label in more than half of its rare
    hashes: copies would count their words many times over."""
    at: dict[tuple[object, int], list[int]] = {}
    kept = []
    for text, label in sample:
        sketch = sorted({zlib.crc32(w) for w in text.encode("utf-8", "surrogatepass").split()})[:SKETCH]
        where = [at.setdefault((label, h), []) for h in sketch]
        rare = [w for w in where if len(w) <= COMMON]
        most = max(Counter(i for w in rare for i in w).values(), default=0)
        if 2 * most <= len(rare):
            for w in where:
                w.append(len(kept))
            kept.append((text, label))
    return kept


def logistic(features: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(mean, scale, weights)`` of a ridge logistic fit by damped Newton steps; column 0 is the constant."""
    mean, scale = features.mean(0), features.std(0)
    mean[0], scale[0] = 0.0, 1.0
    scale = np.where(scale < 1e-9, 1.0, scale)
    x = (features - mean) / scale
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - (target * z).sum() + 0.5 * (pull * v * v).sum())

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (target - p) - pull * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        after = loss(w)
        if now - after < 1e-9 * (1 + abs(now)):
            break
        now = after
    return mean, scale, w


def prior_shift(target: np.ndarray, counts: dict | None) -> float:
    """What the constant of a fit on ``target`` lacks for the labels' true shares, given their counts in all rows."""
    if not counts or not counts.get(0) or not counts.get(1):
        return 0.0
    return float(np.log(counts[1] / counts[0]) - np.log(target.sum() / (len(target) - target.sum())))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
