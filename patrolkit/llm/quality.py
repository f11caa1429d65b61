"""Quality by compression: zstandard dictionaries of good and bad text, and the calibrated difference of the sizes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import utf8, with_batches
from ._training import bounded_sample, logistic, prior_shift, remainder, sigmoid

#: Bounds of the labelled sample: texts of each label, and bytes of a text.
SAMPLE_PER_LABEL = 4000
SAMPLE_MAX_BYTES = 20_000
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Rows that are scored at or over this are predicted good.
CUT = 0.3
HELD_OUT_OF = 5
_PIECE = 512


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration. ``weights`` is None where the sample lacked a label."""

    good: bytes
    bad: bytes
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5

    def scorer(self):
        """The function from texts (bytes) to scores; it owns its compressors, so make one in each task."""
        if self.weights is None:
            return lambda texts: np.full(len(texts), self.prior)
        sizes = _sizer(self.good, self.bad)
        return lambda texts: sigmoid((_features(*sizes(texts)) - self.mean) / self.scale @ self.weights)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    pieces = [t[i : i + _PIECE] for t in texts for i in range(0, len(t), _PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself serves
        return b"".join(pieces)[-size:]


def _sizer(good: bytes, bad: bytes):
    made = []
    for data in (good, bad):
        words = zstandard.ZstdCompressionDict(data)
        words.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_dict_id=False))

    def sizes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = [np.fromiter((len(c.compress(t)) for t in texts), float, len(texts)) for c in made]
        return by[0], by[1], np.fromiter(map(len, texts), float, len(texts))

    return sizes


def _features(by_good: np.ndarray, by_bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The normalised difference of the compressed sizes, with two corrections: the compressed rate, since text that
    repeats itself compresses well under any dictionary, and the length, which both depend on."""
    n = np.maximum(n, 1.0)
    difference = (by_bad - by_good) / (by_bad + by_good)
    rate = np.log((by_good + by_bad) / 2 / n)
    length = np.log(n) / 8
    return np.stack([np.ones_like(n), difference, rate, rate**2, difference * rate, length, rate * length], axis=1)


def fit(sample: list[tuple[str, int]], dictionary_bytes: int = DICTIONARY_BYTES, counts: dict[int, int] | None = None) -> QualityModel:
    """A model from ``(text, label)``: every second text of a label feeds its dictionary, the others the calibration.

    ``counts`` are the labels' counts in all rows, to which the calibration's constant is moved.
    Without texts of both labels the score is the share of good texts (0.5 without any).
    """
    halves: dict[int, tuple[list[bytes], list[bytes]]] = {0: ([], []), 1: ([], [])}
    for text, label in sample:
        both = halves[int(label)]
        both[len(both[0]) > len(both[1])].append(text.encode())
    sizes = [len(halves[k][0]) + len(halves[k][1]) for k in (0, 1)]
    if not halves[0][1] or not halves[1][1]:
        return QualityModel(b"", b"", prior=sizes[1] / sum(sizes) if sum(sizes) else 0.5)
    good, bad = (_dictionary(halves[k][0], dictionary_bytes) for k in (1, 0))
    texts = halves[0][1] + halves[1][1]
    target = np.array([0.0] * len(halves[0][1]) + [1.0] * len(halves[1][1]))
    mean, scale, weights = logistic(_features(*_sizer(good, bad)(texts)), target, ridge=0.05)
    weights[0] += prior_shift(target, counts)
    return QualityModel(good, bad, mean, scale, weights)


def fit_on_tables(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on a bounded sample of labelled rows outside the held-out remainder."""
    rows = labels.where(remainder(F.col("doc_id"), HELD_OUT_OF) != 0).where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample, counts = bounded_sample(rows, docs, "quality", SAMPLE_PER_LABEL, SAMPLE_MAX_BYTES)
    return fit(sample, counts=counts)


def score(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score", *, keep_text: bool = True) -> DataFrame:
    """``docs`` with the calibrated score of every row's whole text; null counts as empty.

    Texts of any length are compressed whole. Repeated rows and rows without an id stay rows, equal texts score alike;
    an empty table gives an empty table; a column that has the score's name stays, and the score's gets underscores in
    front.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES and a few numbers

    def make():
        scorer = shared.value.scorer()

        def work(column: pa.Array) -> list[pa.Array]:
            return [pa.array(scorer([x or b"" for x in utf8(column)]), pa.float64())]

        return work

    return with_batches(docs, text, [T.StructField(name, T.DoubleType())], make, drop_source=not keep_text)
