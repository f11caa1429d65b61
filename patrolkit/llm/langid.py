"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's features are its prefixes, suffixes, character pairs and triples (hashed) and its entry in a lexicon; weights
of features and transitions are learned together by ascent on the likelihood of the label sequences. Labels of words
come from forward-backward: texts are cut into blocks, the block's transfer matrices are chained per text, and the
words inside all blocks are then worked through at once, which gives the exact marginals of the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import scratch, small, with_batches, written
from ._training import remainder, without_copies

#: Bounds of the sample: texts of each language, texts times languages, bytes of a text, words taken from one text, lexicon
#: words. At least one text of each language is learned from.
SAMPLE_PER_LABEL = 800
SAMPLE_TEXTS_TIMES_LANGUAGES = 160_000
SAMPLE_MAX_BYTES = 20_000
FRAGMENT_WORDS = 30
LEXICON_WORDS = 20_000
HELD_OUT_OF, HELD_OUT = 4, 2
FEATURE_SLOTS = 1 << 16
#: Weights (slots and lexicon, each times languages) and numbers that a round of the fit lays out at once (words times
#: languages, about eight such tables); more languages take fewer slots and more batches.
FIT_WEIGHTS, FIT_NUMBERS = 1 << 22, 2_000_000
#: Up to so many labels blocks of words are chained by matrices; more are stepped through word by word, all texts at once.
#: Beyond TIED_LABELS transitions are two numbers, to the same and to another label, and fewer rounds are made.
BLOCK_LABELS, TIED_LABELS = 16, 64
ROUNDS, FEW_ROUNDS = 40, 12
BLOCK = 32
MAX_KNOWN = 300_000
#: Numbers (words times labels, with the blocks' matrices) that the marginals of some texts may lay out at once; a longer
#: text is cut, with the same marginals.
MAX_NUMBERS = 24_000_000
#: Letters of a word at most; longer runs are several words.
WORD_LETTERS = 40
#: Words whose features are laid out at once.
FEATURE_WORDS = 16_384
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The lowered runs of letters; one of more than WORD_LETTERS, as in texts without spaces, is cut into even pieces
    of that many at most, each a word of its own, so every letter is read and a language may change inside the run."""
    low = text.lower()
    words = _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]
    if not words or len(max(words, key=len)) <= WORD_LETTERS:
        return words
    return [piece for w in words for piece in _pieces(w)]


def _pieces(word: str) -> list[str]:
    n = -(-len(word) // WORD_LETTERS)
    edges = [len(word) * i // n for i in range(n + 1)]
    return [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def slots_for(labels: int) -> int:
    """Hashed slots of a field with so many labels: FEATURE_SLOTS, or the power of two that FIT_WEIGHTS allows."""
    return min(FEATURE_SLOTS, 1 << max(8, (FIT_WEIGHTS // max(1, labels)).bit_length() - 1))


def _slot(codes: list[np.ndarray], salt: int, slots: int) -> np.ndarray:
    """Hashed slots of equally long strings, given the code points of each place."""
    mixed = np.uint64(salt * int(_MIX[3]) % (1 << 64))
    for place, code in enumerate(codes):
        mixed = (mixed + (code + np.uint64(1)) * _MIX[place % 3]) * _MIX[1]
        mixed = mixed ^ (mixed >> np.uint64(29))
    return ((mixed * _MIX[0]) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def feature_sections(words: list[str], lexicon: dict[str, int], hashed: int = FEATURE_SLOTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots of the words' features, as ``(slots, starts)``: a section holds some slots of each word, one word after
    the other. Pairs and triples of the framed word, prefixes and suffixes of three and four letters, lexicon entry."""
    none = hashed + len(lexicon)  # a slot whose weights stay zero
    framed = [f"^{w}$" for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    out = []
    for k in (2, 3):
        count = sizes - k + 1
        starts = np.cumsum(count) - count
        at = np.repeat(begin - starts, count) + np.arange(int(count.sum()))
        out.append((_slot([codes[at + j] for j in range(k)], k, hashed), starts))
    one = np.arange(len(words))
    for k in (3, 4):
        fits = sizes - 2 >= k
        for salt, first in ((10 + k, begin + 1), (20 + k, begin + sizes - 1 - k)):
            first = np.where(fits, first, 0)
            slots = _slot([codes[np.minimum(first + j, len(codes) - 1)] for j in range(k)], salt, hashed)
            out.append((np.where(fits, slots, none), one))
    out.append((np.fromiter((hashed + lexicon[w] if w in lexicon else none for w in words), np.int64, len(words)), one))
    return out


def emission_scores(weights: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return sum(np.add.reduceat(weights[slots], starts, axis=0) for slots, starts in sections)


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of every word, texts one after the other; the label before a text is uniform.

    ``emission`` holds scores (words x labels), ``transition`` scores (from x to). All texts must have a word.
    """
    forward, backward = forward_backward(emission, lengths, transition)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def _stepped(state: np.ndarray, transition: np.ndarray, back: bool = False) -> np.ndarray:
    """Weights of labels a word on (or back); tied transitions need no matrix."""
    step = np.exp(transition - transition.max())
    if step.ndim == 1:
        return state * (step[0] - step[1]) + step[1] * state.sum(axis=1, keepdims=True)
    return state @ (step.T if back else step)


def _even(rows: np.ndarray) -> np.ndarray:
    return rows / rows.sum(axis=1, keepdims=True)


def _by_words(peak: np.ndarray, lengths: np.ndarray, transition: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`forward_backward`, a word of all texts at a time."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    live = np.searchsorted(-lengths[order], -np.arange(int(lengths.max())))
    forward, backward = np.empty_like(peak), np.empty_like(peak)
    state = before[order]
    for t, m in enumerate(live.tolist()):
        state[:m] = _even(_stepped(state[:m], transition) * peak[first[:m] + t])
        forward[first[:m] + t] = state[:m]
    state = _even(after[order])
    for t, m in reversed(list(enumerate(live.tolist()))):
        backward[first[:m] + t] = state[:m]
        state[:m] = _even(_stepped(peak[first[:m] + t] * state[:m], transition, back=True))
    return forward, backward


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every word the weights of its labels by what stands up to it, and by what follows it, each row summing to one.

    ``before`` and ``after`` (texts x labels) are the weights that a text's first word follows and its last word meets.
    """
    n, k = emission.shape
    if not n:
        return np.zeros((0, k)), np.zeros((0, k))
    peak = np.exp(emission - emission.max(axis=1, keepdims=True))
    before = np.full((len(lengths), k), 1.0 / k) if before is None else before
    after = np.ones((len(lengths), k)) if after is None else after
    if k > BLOCK_LABELS or transition.ndim == 1:
        return _by_words(peak, lengths, transition, before, after)
    step = np.exp(transition - transition.max())
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    text_of = np.repeat(np.arange(len(lengths)), blocks)
    first_block = np.cumsum(blocks) - blocks
    rank = np.arange(total) - first_block[text_of]
    text_start = np.cumsum(lengths) - lengths
    start = text_start[text_of] + rank * BLOCK
    size = np.minimum(BLOCK, lengths[text_of] - rank * BLOCK)

    order = np.argsort(-size, kind="stable")  # long blocks first, so that the live ones are always a leading slice
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)
    start, size = start[order], size[order]
    live = [int(np.searchsorted(-size, -t)) for t in range(BLOCK)]  # blocks of more than t words

    chain = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t, m in enumerate(live):
        if not m:
            break
        grown = (chain[:m].reshape(-1, k) @ step).reshape(-1, k, k) * peak[start[:m] + t][:, None, :]
        chain[:m] = grown / grown.sum(axis=(1, 2), keepdims=True)

    into, out = np.empty((total, k)), np.empty((total, k))  # weights before the block's first and behind its last word
    now, later = before.astype(float), after.astype(float)
    by_blocks = np.argsort(-blocks, kind="stable")
    many = -blocks[by_blocks]
    for r in range(int(blocks.max())):
        texts = by_blocks[: int(np.searchsorted(many, -r))]
        at = place[first_block[texts] + r]
        into[at] = now[texts]
        grown = np.einsum("bi,bij->bj", now[texts], chain[at])
        now[texts] = grown / grown.sum(axis=1, keepdims=True)
        at = place[first_block[texts] + blocks[texts] - 1 - r]
        out[at] = later[texts]
        grown = np.einsum("bij,bj->bi", chain[at], later[texts])
        later[texts] = grown / grown.sum(axis=1, keepdims=True)

    forward = np.empty((n, k))
    state = into
    for t, m in enumerate(live):
        if not m:
            break
        grown = (state[:m] @ step) * peak[start[:m] + t]
        grown /= grown.sum(axis=1, keepdims=True)
        state[:m] = grown
        forward[start[:m] + t] = grown
    backward = np.empty((n, k))
    state = out / out.sum(axis=1, keepdims=True)
    for t in reversed(range(BLOCK)):
        m = live[t]
        at = start[:m] + t
        backward[at] = state[:m]
        grown = (peak[at] * state[:m]) @ step.T
        state[:m] = grown / grown.sum(axis=1, keepdims=True)
    return forward, backward


def long_marginals(emission_of, words: list[str], transition: np.ndarray, labels: int, most: int):
    """``(first word, marginals)`` of one text's cuts, last one first, from the same sums as in one piece.

    Cuts of ``most`` words are gone through from the front for the weights that each follows, then from the back.
    """
    starts = list(range(0, len(words), most))
    follows = [np.full((1, labels), 1.0 / labels)]
    one = lambda cut: np.array([len(cut)])
    for at in starts[:-1]:
        cut = words[at : at + most]
        follows.append(forward_backward(emission_of(cut), one(cut), transition, follows[-1])[0][-1:])
    after = np.ones((1, labels))
    for at, before in zip(reversed(starts), reversed(follows), strict=True):
        cut = words[at : at + most]
        emission = emission_of(cut)
        forward, backward = forward_backward(emission, one(cut), transition, before, after)
        first = np.exp(emission[:1] - emission[:1].max()) * backward[:1]
        after = _even(_stepped(first, transition, back=True))
        yield at, _even(forward * backward)


@dataclass(frozen=True)
class Crf:
    labels: list[str]
    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None  # (slots x labels)
    transition: np.ndarray | None = None  # (from x to), or for many labels (to the same, to another)


class Emissions:
    """Scores of words, each computed once in a task; forgotten beyond MAX_KNOWN words."""

    def __init__(self, model: Crf):
        self.model = model
        self.row: dict[str, int] = {}
        self.scores = np.empty((1024, len(model.labels)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.row) > min(MAX_KNOWN, MAX_NUMBERS // max(1, len(self.model.labels))):
            self.row.clear()
        row = self.row
        fresh = list({w: None for w in words if w not in row})
        if fresh:
            at = len(row)
            while at + len(fresh) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            for a in range(0, len(fresh), FEATURE_WORDS):
                some = fresh[a : a + FEATURE_WORDS]
                self.scores[at + a : at + a + len(some)] = emission_scores(self.model.weights, feature_sections(some, self.model.lexicon, len(self.model.weights) - len(self.model.lexicon) - 1))
            row.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return self.scores[np.fromiter(map(row.__getitem__, words), np.int64, len(words))].astype(float)


@dataclass
class _Batch:
    """Some training sequences: their words as numbers of distinct words, and these words' features."""

    which: np.ndarray
    target: np.ndarray
    lengths: np.ndarray
    types: int
    sections: list[tuple[np.ndarray, np.ndarray]]
    owners: list[np.ndarray]

    def add_slopes(self, slope: np.ndarray, weights: np.ndarray, transition: np.ndarray, share: float) -> np.ndarray:
        """Adds ``share`` of the slopes by the weights to ``slope``, and returns those by the transitions."""
        k = weights.shape[1]
        emission = emission_scores(weights, self.sections)[self.which]
        truth = np.zeros_like(emission)
        truth[np.arange(len(truth)), self.target] = 1.0
        gap, slope_t = likelihood_slopes(emission, self.lengths, transition, self.target, truth)
        per_type = _summed(gap, self.which, np.zeros((self.types, k)), 1.0)
        for (slots, _), owner in zip(self.sections, self.owners, strict=True):
            _summed(per_type, slots, slope, share, owner)
        return slope_t


def _summed(rows: np.ndarray, at: np.ndarray, out: np.ndarray, share: float, row_of: np.ndarray | None = None) -> np.ndarray:
    """``out`` with ``share`` of the rows (or of rows ``row_of``) added at ``at``: label by label, or in runs of the sorted places."""
    k = rows.shape[1]
    if k <= TIED_LABELS:
        for j in range(k):
            value = rows[:, j] if row_of is None else rows[row_of, j]
            out[:, j] += np.bincount(at, value, len(out)) * share
        return out
    order = np.argsort(at, kind="stable")
    piece = max(1, FIT_NUMBERS // k)
    for low in range(0, len(order), piece):
        some = order[low : low + piece]
        places, starts = np.unique(at[some], return_index=True)
        out[places] += np.add.reduceat(rows[some if row_of is None else row_of[some]], starts, axis=0) * share
    return out


def fit(sample: list[tuple[str, str]], rounds: int | None = None, rate: float = 0.3, ridge: float = 1e-4, seed: int = 5) -> Crf:
    """A field from ``(text, language)``. Sequences are fragments of one text or two fragments joined (a switch).

    Every round adds up the slopes of batches, so memory holds three tables of FIT_WEIGHTS weights and about eight of
    FIT_NUMBERS numbers, whatever the number of languages.
    """
    labels = sorted({lang for _, lang in sample})
    if not labels:
        return Crf([])
    place = {lang: i for i, lang in enumerate(labels)}
    k, slots = len(labels), slots_for(len(labels))
    tied = k > TIED_LABELS
    draw = np.random.default_rng(seed)
    fragments = []
    for text, lang in sample:
        words = words_of(text)
        if words:
            at = int(draw.integers(0, max(1, len(words) - FRAGMENT_WORDS + 1)))
            fragments.append((words[at : at + FRAGMENT_WORDS], place[lang]))
    transition = np.zeros(2 if tied else (k, k))
    if not fragments:
        return Crf(labels, {}, np.zeros((slots + 1, k)), transition)
    sequences = [[f] for f in fragments]
    order = draw.permutation(len(fragments))
    sequences += [[fragments[a], fragments[b]] for a, b in zip(order[::2].tolist(), order[1::2].tolist(), strict=False)]
    common = Counter(w for seq in sequences for part, _ in seq for w in part).most_common(min(LEXICON_WORDS, FIT_WEIGHTS // k))
    lexicon = {w: i for i, (w, c) in enumerate(common) if c > 2}
    batches = [_batch(some, lexicon, slots) for some in _runs(sequences, max(1, FIT_NUMBERS // k))]
    weights = np.zeros((slots + len(lexicon) + 1, k))
    seen, seen_t = np.full_like(weights, 1e-3), np.full_like(transition, 1e-3)
    for _ in range(rounds or (FEW_ROUNDS if tied else ROUNDS)):
        slope, slope_t = -ridge * weights, np.zeros_like(transition)
        for batch in batches:
            slope_t += batch.add_slopes(slope, weights, transition, 1.0 / len(sequences))
        slope[-1] = 0.0
        seen += slope**2
        slope /= np.sqrt(seen)
        weights += rate * slope
        slope_t = slope_t / len(sequences) - ridge * transition
        seen_t += slope_t**2
        transition += rate * slope_t / np.sqrt(seen_t)
    return Crf(labels, lexicon, weights.astype(np.float32), transition)


def _runs(sequences: list, most: int) -> list[list]:
    """The sequences in runs of about ``most`` words."""
    out, held = [[]], 0
    for seq in sequences:
        size = sum(len(part) for part, _ in seq)
        if out[-1] and held + size > most:
            out.append([])
            held = 0
        out[-1].append(seq)
        held += size
    return out


def _batch(sequences: list, lexicon: dict[str, int], slots: int) -> _Batch:
    words = [w for seq in sequences for part, _ in seq for w in part]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    sections = feature_sections(list(number), lexicon, slots)
    owners = [np.repeat(np.arange(len(number)), np.diff(np.append(starts, len(at)))) for at, starts in sections]
    target = np.array([label for seq in sequences for part, label in seq for _ in part])
    lengths = np.array([sum(len(part) for part, _ in seq) for seq in sequences])
    return _Batch(np.array([number[w] for w in words]), target, lengths, len(number), sections, owners)


def likelihood_slopes(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, target: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the log-likelihood of the labels ``target`` (``truth``: as 0 and 1) by every word's scores and by the transitions.

    Pair marginals are forward x transition x evidence of the next word x backward, each word's evidence once. The label
    before a text is hidden and uniform, so the text's first step counts by its share of each such label.
    """
    forward, backward = forward_backward(emission, lengths, transition)
    post = forward * backward
    post /= post.sum(axis=1, keepdims=True)
    step = np.exp(transition - transition.max())
    behind = np.exp(emission - emission.max(axis=1, keepdims=True)) * backward
    if step.ndim == 1:
        return truth - post, _tied_slopes(forward, behind, step, lengths, target)
    k = len(transition)
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(target), bool)
    inner[first] = False
    to = np.flatnonzero(inner)
    # expected pairs, summed: step * sum of outer(forward, behind) / each pair's total
    total = np.einsum("ij,ij->i", forward[to - 1] @ step, behind[to])
    expected = step * (forward[to - 1].T @ (behind[to] / total[:, None]))
    start = behind[first]
    expected += step * (start / (start @ step.T).sum(axis=1, keepdims=True)).sum(axis=0)[None, :]
    given = np.zeros((k, k))
    np.add.at(given, (target[to - 1], target[to]), 1.0)
    given += step / step.sum(axis=0, keepdims=True) * np.bincount(target[first], minlength=k)[None, :]
    return truth - post, given - expected


def _tied_slopes(forward: np.ndarray, behind: np.ndarray, step: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Slopes by the two tied transitions: how often the label stays and changes, less how often that is expected."""
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(target), bool)
    inner[first] = False
    to = np.flatnonzero(inner)
    stays = step[0] * np.einsum("ij,ij->i", forward[to - 1], behind[to])
    moves = step[1] * (forward[to - 1].sum(axis=1) * behind[to].sum(axis=1)) - step[1] * stays / step[0]
    expected = (stays / (stays + moves)).sum()
    given = float((target[to] == target[to - 1]).sum())
    return np.array([given - expected, expected - given])  # a text's first step expects what it is given


def _sample(rows: DataFrame, docs: DataFrame, per_label: int) -> list[tuple[str, str]]:
    """About ``per_label`` texts of each language, one at least where it has one, in an order that the ids decide.

    A language's share is joined from the table of their counts, so any number of languages is sampled in one pass; ids
    with two languages and texts that are null or longer than SAMPLE_MAX_BYTES are left out.
    """
    known = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_MAX_BYTES)).select("doc_id").distinct()
    single = rows.groupBy("doc_id").agg(F.min("lang").alias("label"), F.max("lang").alias("other")).where("label = other").select("doc_id", "label").join(known, "doc_id")
    single = written(single.withColumn("draw", F.xxhash64("doc_id", F.lit(11))), "single")
    shares = single.groupBy(F.col("label").alias("of")).agg((F.lit(float(per_label)) / F.count("*")).alias("share"), F.min("draw").alias("least"))
    within = F.pmod("draw", F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.col("share")
    chosen = single.join(small(shares), F.col("label") == F.col("of")).where(within | (F.col("draw") == F.col("least"))).select("doc_id", "label", "draw")
    texts = docs.where(F.octet_length("text") <= SAMPLE_MAX_BYTES).select("doc_id", "text")
    joined = texts.join(small(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("draw").alias("draw"))
    got = sorted((r["draw"], r["doc_id"], r["text"], r["label"]) for r in joined.collect())  # bounded by the sample
    return without_copies([(text, label) for _, _, text, label in got])


def fit_on_tables(docs: DataFrame) -> Crf:
    """Fits on a bounded sample of documents with a language, outside the held-out remainder. Every language is learned."""
    rows = docs.where((remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT) & F.col("lang").isNotNull()).select("doc_id", "lang")
    languages = max(1, rows.agg(F.count_distinct("lang").alias("n")).first()["n"])
    per_label = max(1, min(SAMPLE_PER_LABEL, SAMPLE_TEXTS_TIMES_LANGUAGES // languages**2))
    with scratch():
        return fit(_sample(rows, docs, per_label))


def numbers_of(sizes: np.ndarray, labels: int) -> np.ndarray:
    """Numbers that the marginals of texts of so many words lay out."""
    return sizes * labels * 6 + (-(-sizes // BLOCK) * labels * labels if labels <= BLOCK_LABELS else 0)


def groups_of(texts: np.ndarray, sizes: np.ndarray, labels: int, most: int = MAX_NUMBERS) -> list[np.ndarray]:
    """``texts`` (with their numbers of words) in runs whose marginals lay out at most ``most`` numbers, or one text."""
    out, held, start = [], 0, 0
    for i, size in enumerate(numbers_of(sizes, labels).tolist()):
        if i > start and held + size > most:
            out.append(texts[start:i])
            start, held = i, 0
        held += size
    return [*out, texts[start:]] if len(texts) else out


def word_weights(words: list[str]) -> np.ndarray:
    """One over the root of each word's count in its text, so that a repeated phrase does not outvote the rest."""
    count = Counter(words)
    return 1.0 / np.sqrt(np.fromiter(map(count.__getitem__, words), float, len(words)))


RUNS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("lang", T.StringType())]))


def label(docs: DataFrame, model: Crf, text: str = "text", *, keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and switches (runs of :func:`words_of` by likeliest label) of every row's whole text.

    lang_pred is the label with most expected words, each weighted by :func:`word_weights`, and score its plain share; ``und`` and 0 for null texts, texts without a
    letter, and a field without labels; of equal votes the label that comes first by name wins. ``switches`` is empty
    where one label holds throughout. Texts of any length are read whole, in bounded slices. Repeated rows and rows
    without an id stay rows; an empty table gives an empty table; columns that have the new names stay, and the new ones
    get underscores in front.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of FIT_WEIGHTS weights at most

    def make():
        model = shared.value
        known = Emissions(model)

        def one_long(i: int, words: list[str], langs: list, scores: list, runs: list) -> None:
            k, weight = len(model.labels), word_weights(words)
            best, share, votes = np.empty(len(words), np.int32), np.zeros(k), np.zeros(k)
            for at, post in long_marginals(known.of, words, model.transition, k, max(BLOCK, MAX_NUMBERS // (8 * k) // BLOCK * BLOCK)):
                best[at : at + len(post)] = post.argmax(axis=1)
                share += post.sum(axis=0) / len(words)
                votes += weight[at : at + len(post)] @ post
            top = int(votes.argmax())
            langs[i], scores[i] = model.labels[top], float(min(1.0, share[top]))
            edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(words)]
            if len(edges) > 2:
                runs[i] = [{"first_word": x, "end_word": y, "lang": model.labels[best[x]]} for x, y in zip(edges, edges[1:], strict=False)]

        def one_group(some: np.ndarray, texts: list, sizes: np.ndarray, langs: list, scores: list, runs: list) -> None:
            post = marginals(known.of([w for i in some for w in texts[i]]), sizes[some], model.transition)
            starts = np.cumsum(sizes[some]) - sizes[some]
            weight = np.concatenate([word_weights(texts[i]) for i in some])
            share = np.add.reduceat(post, starts, axis=0) / sizes[some][:, None]
            votes = np.add.reduceat(post * weight[:, None], starts, axis=0)
            best = post.argmax(axis=1)
            change = np.flatnonzero(np.diff(best)) + 1
            for j, i in enumerate(some.tolist()):
                top = int(votes[j].argmax())
                langs[i], scores[i] = model.labels[top], float(min(1.0, share[j, top]))
                a, b = int(starts[j]), int(starts[j] + sizes[i])
                cuts = change[np.searchsorted(change, a, "right") : np.searchsorted(change, b)]
                if len(cuts):
                    edges = [a, *cuts.tolist(), b]
                    runs[i] = [{"first_word": x - a, "end_word": y - a, "lang": model.labels[best[x]]} for x, y in zip(edges, edges[1:], strict=False)]

        def work(column: pa.Array) -> list[pa.Array]:
            texts = [words_of(v) if v and model.labels else [] for v in column.to_pylist()]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            full = np.flatnonzero(sizes)
            langs, scores, runs = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for some in groups_of(full, sizes[full], len(model.labels)):
                if len(some) == 1 and numbers_of(sizes[some], len(model.labels))[0] > MAX_NUMBERS:
                    one_long(int(some[0]), texts[int(some[0])], langs, scores, runs)
                else:
                    one_group(some, texts, sizes, langs, scores, runs)
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("lang", pa.string())]))
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(runs, kind)]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("switches", RUNS)]
    return with_batches(docs, text, fields, make, drop_source=not keep_text)
