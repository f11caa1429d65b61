"""Toxic passages: maximal scoring segments over token log-odds, with extreme-value calibration.

Token scores are log-odds between toxic and clean training text under an informative Dirichlet prior (the prior is the
token's share of all training text), kept where the share is significant. A linear scan (all maximal segments, by
Ruzzo and Tompa) lists every segment of positive score. Segment scores are turned into tail probabilities by a Gumbel
law whose scale comes from the equation sum(p * exp(lambda * s)) = 1 over clean tokens and whose location is matched to
the clean documents; the sum of a document's significant segments goes through a logistic calibration.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import with_batches
from ._training import bounded_sample, logistic, prior_shift, remainder, sigmoid

#: Bounds of the labelled sample: texts of each label, bytes of a text, and tokens with a score of their own.
SAMPLE_PER_LABEL = 3000
SAMPLE_MAX_BYTES = 20_000
LEXICON_TOKENS = 50_000
HELD_OUT_OF, HELD_OUT = 4, 2
CUT = 0.3
FOLDS = 5
#: The prior's weight in tokens, the root deviance that a token of half the sample must exceed (it grows with the root
#: of the sample's size), and what each neutral token costs.
PRIOR_TOKENS = 2000.0
LEAST_ROOT = 3.6
NEUTRAL = -0.05
#: Besides whole words, the first letters of longer words are tokens, so that inflected forms share what is learned.
STEMS = (8, 7, 6, 5, 4)
#: Word scores remembered in one task; the table is emptied beyond that.
MAX_KNOWN = 300_000
#: Passages are significant under this expected number of equal ones in clean text of the document's length.
MAX_EXPECTED = 0.05
_WORD = re.compile(r"[^\W\d_]+")

PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


def tokens(text: str) -> tuple[list[str], str]:
    """Lower-case words, and the text in which their offsets hold."""
    low = text.lower()
    if len(low) == len(text):
        return _WORD.findall(low), low
    return [w.lower() for w in _WORD.findall(text)], text


def forms(word: str) -> list[str]:
    """The tokens of a word, most special first: itself, then its stems (marked, so that no word equals one)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class WordScores(dict):
    """Scores of words, filled as they are met: the first of the word's tokens that the lexicon holds decides."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        got = next((self.lexicon[f] for f in forms(word) if f in self.lexicon), NEUTRAL)
        if len(self) >= MAX_KNOWN:
            self.clear()
        self[word] = got
        return got

    def of(self, words: list[str]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=float)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, end, score)`` in order, in time linear in the number of positive scores."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[list[float]] = []  # first, end, total before it, total after it
    earlier: list[int] = []  # for each kept segment, the nearest one before it with a smaller total before it
    for at in positive.tolist():
        segment = [at, at + 1, total[at], total[at + 1]]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= segment[2]:
                j = earlier[j]
            if j < 0 or kept[j][3] >= segment[3]:
                kept.append(segment)
                earlier.append(j)
                break
            segment = [kept[j][0], segment[1], kept[j][2], segment[3]]
            del kept[j:], earlier[j:]
    return [(int(a), int(b), float(after - before)) for a, b, before, after in kept]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    scale: float  # lambda of the extreme-value law
    location: float  # ln K
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5

    def segments(self, words: list[str], known: WordScores) -> list[tuple[int, int, float, float]]:
        """Significant segments with the number of equal ones that clean text of this length would hold."""
        return self.significant(maximal_segments(known.of(words)), len(words))

    def significant(self, found: list[tuple[int, int, float]], length: int) -> list[tuple[int, int, float, float]]:
        out = []
        for first, end, score in found:
            expected = float(np.exp(min(50.0, self.location + np.log(length) - self.scale * score)))
            if expected <= MAX_EXPECTED:
                out.append((first, end, score, expected))
        return out

    def score(self, segments: list[tuple[int, int, float, float]]) -> float:
        if self.weights is None:
            return self.prior
        return float(sigmoid((_features([segments]) - self.mean) / self.spread @ self.weights)[0])


def _features(of: list[list[tuple[int, int, float, float]]]) -> np.ndarray:
    rows = []
    for segments in of:
        evidence = sorted((-np.log(max(s[3], 1e-30)) for s in segments), reverse=True)
        rows.append([1.0, evidence[0] if evidence else 0.0, np.log1p(sum(evidence)), float(bool(evidence))])
    return np.array(rows)


def log_odds(names: list[str], whole: np.ndarray, toxic: np.ndarray, clean: np.ndarray, least_root: float = LEAST_ROOT) -> dict[str, float]:
    """Scores of the tokens whose toxic share differs from that of all tokens; at most LEXICON_TOKENS of them.

    ``toxic`` and ``clean`` count each name's texts; ``whole`` marks whole words, whose counts make the totals. What
    differs is decided by the root of the token's binomial deviance, which, unlike a standard error of log-odds, holds for
    tokens that one side never shows.
    """
    n1, n0 = float(toxic[whole].sum()), float(clean[whole].sum())
    every = n1 + n0
    if not n1 or not n0:
        return {}
    share = n1 / every
    k, m = toxic.astype(float), (toxic + clean).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log(x / y), 0.0) for x, y in ((k, m * share), (m - k, m * (1 - share)))]
    root = np.sqrt(np.maximum(0.0, 2 * (parts[0] + parts[1])))
    at = np.flatnonzero((root >= least_root) & (m > 0))
    prior = PRIOR_TOKENS * m[at] / every
    a, b = k[at] + prior, m[at] - k[at] + prior
    odds = np.log(a / (n1 + PRIOR_TOKENS - a)) - np.log(b / (n0 + PRIOR_TOKENS - b)) + NEUTRAL
    found = sorted(((root[i], names[i], float(o)) for i, o in zip(at.tolist(), odds, strict=True)), reverse=True)
    return {word: value for _, word, value in found[:LEXICON_TOKENS]}


def _extreme_scale(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum(shares * exp(lambda * values)) = 1, by bisection."""
    if not (values > 0).any() or (values * shares).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (shares * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return high


def fit(sample: list[tuple[str, int]], counts: dict[int, int] | None = None) -> ToxicityModel:
    """A model from ``(text, label)``: log-odds of all texts, with law and calibration from texts out of the fold.

    The texts of each label are dealt to FOLDS folds. A fold's texts are scored by the log-odds of the other folds, whose
    threshold is scaled to their share of the texts, so that they stand for the log-odds of all; the law's scale and
    location and the calibration come from those scores. ``counts`` are the labels' counts in all rows, to which the
    calibration's constant is moved. Without FOLDS texts of both labels the score is the share of toxic texts (0.5
    without any).
    """
    words: list[list[str]] = [tokens(text)[0] for text, _ in sample]
    labels = np.array([int(label) for _, label in sample], dtype=int)
    sizes = [int((labels == k).sum()) for k in (0, 1)]
    if min(sizes) < FOLDS:
        return ToxicityModel({}, 1.0, 0.0, prior=sizes[1] / sum(sizes) if sum(sizes) else 0.5)
    fold = np.empty(len(labels), int)
    for k in (0, 1):
        fold[labels == k] = np.arange(sizes[k]) % FOLDS
    forms_of: dict[str, list[int]] = {}
    number: dict[str, int] = {}
    seen = []
    for text in words:
        numbers: set[int] = set()
        for w in set(text):
            if w not in forms_of:
                forms_of[w] = [number.setdefault(f, len(number)) for f in forms(w)]
            numbers.update(forms_of[w])
        seen.append(np.fromiter(numbers, np.int64, len(numbers)))
    names = list(number)
    whole = np.array([not f.endswith("*") for f in names], bool)
    count = lambda texts: np.bincount(np.concatenate([seen[i] for i in texts.tolist()] or [np.empty(0, np.int64)]), minlength=len(names))
    parts = [[count(np.flatnonzero((labels == k) & (fold == f))) for f in range(FOLDS)] for k in (0, 1)]
    clean, toxic = (sum(p) for p in parts)
    root = LEAST_ROOT * (2.0 * (FOLDS - 1) / FOLDS) ** 0.5
    scores: list[np.ndarray] = [np.empty(0)] * len(words)
    met: Counter = Counter()
    for f in range(FOLDS):
        lexicon = log_odds(names, whole, toxic - parts[1][f], clean - parts[0][f], root)
        known = WordScores(lexicon)
        for i in np.flatnonzero(fold == f).tolist():
            scores[i] = known.of(words[i])
            if not labels[i]:
                met.update(scores[i].tolist())
        met.update({v: PRIOR_TOKENS / 1000 / max(1, len(lexicon)) / FOLDS for v in lexicon.values() if v > 0})  # none is impossible in clean text
    scale = _extreme_scale(np.array(list(met)), np.array(list(met.values())) / sum(met.values()))
    found = [maximal_segments(s) for s in scores]
    tops = [scale * max((s[2] for s in found[i]), default=0.0) - np.log(max(1, len(words[i]))) for i in np.flatnonzero(labels == 0).tolist()]
    location = float(np.mean(tops)) - 0.5772  # a Gumbel law's mean lies Euler's constant over its location
    lexicon = log_odds(names, whole, toxic, clean, LEAST_ROOT * 2**0.5)
    plain = ToxicityModel(lexicon, scale, location)
    rows = [plain.significant(s, len(w)) for s, w in zip(found, words, strict=True)]
    target = labels.astype(float)
    mean, spread, weights = logistic(_features(rows), target, ridge=0.1)
    weights[0] += prior_shift(target, counts)
    return ToxicityModel(lexicon, scale, location, mean, spread, weights)


def fit_on_tables(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fits on a bounded sample of labelled rows outside the held-out remainder."""
    rows = labels.where(remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT).where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample, counts = bounded_sample(rows, docs, "toxic", SAMPLE_PER_LABEL, SAMPLE_MAX_BYTES)
    return fit(sample, counts)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", *, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` and ``passages`` (code-point offsets) of every row's whole text; null counts as empty.

    Equal maximal segments stay apart, in text order. Repeated rows and rows without an id stay rows; an empty table
    gives an empty table; columns that have the new names stay, and the new ones get underscores in front.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON_TOKENS scores at most

    def make():
        model = shared.value
        known = WordScores(model.lexicon)

        def work(column: pa.Array) -> list[pa.Array]:
            scores, passages = [], []
            for value in column.to_pylist():
                words, base = tokens(value or "")
                found = model.segments(words, known) if words else []
                scores.append(model.score(found))
                spans = []
                if found:
                    places = [m.span() for m in _WORD.finditer(base)]
                    spans = [{"start": places[a][0], "end": places[b - 1][1], "score": s, "expected": e} for a, b, s, e in found]
                passages.append(spans)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
            return [pa.array(scores, pa.float64()), pa.array(passages, kind)]

        return work

    return with_batches(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGE)], make, drop_source=not keep_text)
