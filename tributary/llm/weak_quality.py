"""Quality classification from weak labels.

Heuristic labellers vote good, bad or nothing on every text.  Several look at each kind of
fault, so their votes overlap.  Expectation-maximisation over the counts of vote patterns of
all documents estimates, for good texts and for each kind of fault, how common they are and
how often each labeller calls them bad; that gives each pattern a posterior chance of being
good.  On a bounded sample those posteriors train a linear scorer over hashed word shapes,
which then scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nothing_heavy, part_sizes, slices, utf8_list

#: Expected texts that the scorer is fitted on, at most.
TRAIN_DOCS = 6_000
BUCKETS = 1 << 12
#: A longer word shape counts as several.
SHAPE = 24
#: Distinct words whose bucket a worker remembers.
MEMO = 100_000
GOOD, BAD, NOTHING = 2, 1, 0

_UPPER = bytes(range(65, 91))
_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_SYMBOL = b"#$%&*|<>{}[]=~^_@\\+"
_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))
_MARKED = re.compile(rb"[" + re.escape(_SYMBOL) + rb"](?=[\s.,;:!?]|\Z)")
_RUN = re.compile(rb"([aA0])\1+")


def statistics(text: bytes) -> dict:
    words, lines = text.split(), text.split(b"\n")
    count = lambda kinds: len(text) - len(text.translate(None, kinds))
    return {
        "bytes": len(text),
        "words": len(words),
        "distinct_words": len(set(words)),
        "letters": count(_LETTER),
        "upper": count(_UPPER),
        "upper_words": sum(map(bytes.isupper, words)),
        "symbols": count(_SYMBOL),
        "marked_words": len(_MARKED.findall(text)),
        "exclamations": text.count(b"!"),
        "exclaimed": text.count(b"!!"),
        "stops": text.count(b". ") + text.count(b".\n") + text.count(b"? ") + text.endswith((b".", b"?", b"!")),
        "repeats": sum(map(eq, words, words[1:])),
        "lines": len(lines),
        "distinct_lines": len(set(lines)),
        "line_bytes": sum(map(len, set(lines))),
    }


@dataclass(frozen=True)
class Labeller:
    """Votes on ``share``: bad where it is over ``bad`` (or under, if that is the smaller),
    good on the other side of ``good``, nothing between or on fewer than ``least`` of
    ``of``."""

    fault: str
    top: str
    of: str
    good: float
    bad: float
    least: int = 1
    complement: bool = False

    def __call__(self, s: dict) -> int:
        if s[self.of] < self.least:
            return NOTHING
        x = s[self.top] / s[self.of]
        x = 1 - x if self.complement else x
        sign = 1 if self.bad > self.good else -1
        return BAD if sign * (x - self.bad) > 0 else GOOD if sign * (self.good - x) > 0 else NOTHING


LABELLERS = (
    Labeller("symbols", "symbols", "words", 0.02, 0.15),
    Labeller("symbols", "marked_words", "words", 0.02, 0.1),
    Labeller("symbols", "letters", "bytes", 0.74, 0.6),
    Labeller("shouting", "upper", "letters", 0.1, 0.35),
    Labeller("shouting", "exclamations", "words", 0.02, 0.2),
    Labeller("shouting", "upper_words", "words", 0.1, 0.4),
    Labeller("shouting", "exclaimed", "words", 0.01, 0.1),
    Labeller("stutter", "repeats", "words", 0.03, 0.15),
    Labeller("stutter", "distinct_words", "words", 0.3, 0.12, 40),
    Labeller("lines", "distinct_lines", "lines", 0.1, 0.6, 4, True),
    Labeller("lines", "line_bytes", "bytes", 0.2, 0.6, 400, True),
    Labeller("prose", "stops", "words", 0.02, 0.002, 40),
)
FAULTS = tuple(dict.fromkeys(x.fault for x in LABELLERS))


def pattern(text: bytes) -> int:
    """All votes, in base 3."""
    s, out = statistics(text), 0
    for labeller in LABELLERS:
        out = out * 3 + labeller(s)
    return out


def votes_of(patterns: np.ndarray, m: int = len(LABELLERS)) -> np.ndarray:
    return np.stack([patterns // 3 ** (m - 1 - j) % 3 for j in range(m)], 1) if len(patterns) else np.zeros((0, m), np.int64)


@dataclass
class LabelModel:
    """``shares`` of good texts and of each kind of fault, in this order; ``alarms[y, j]``:
    how often labeller j, where it votes, calls a text of kind y bad; ``accuracy``: how often
    its votes are right."""

    shares: np.ndarray
    alarms: np.ndarray
    accuracy: np.ndarray

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """Posterior chance of each kind for each pattern; no vote tells nothing."""
        logs = np.log(self.shares) + (votes == BAD) @ np.log(self.alarms).T + (votes == GOOD) @ np.log1p(-self.alarms).T
        chances = np.exp(logs - logs.max(1, keepdims=True)) if len(votes) else logs
        return chances / chances.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.kinds(votes)[:, 0]


# Prior counts (bad, good) of a labeller's votes: on good texts, on texts with a fault that it
# looks for, on texts with another fault.  A few votes of data outweigh them.
PRIORS = ((1.0, 20.0), (4.0, 2.0), (1.0, 5.0))


def fit_labels(votes: np.ndarray, counts: np.ndarray, fault_of: tuple[int, ...], rounds: int = 300) -> LabelModel:
    """Expectation-maximisation over vote patterns; ``fault_of`` numbers each labeller's kind
    of fault from 1.  Texts begin by the share of a fault's labellers that call them bad."""
    kinds = 1 + max(fault_of)
    own = np.equal.outer(np.arange(kinds), fault_of)
    prior = np.where(own[..., None], PRIORS[1], PRIORS[2])
    prior[0] = PRIORS[0]
    bad, good = votes == BAD, votes == GOOD
    theirs = own[1:].T.astype(float)
    shared = (bad @ theirs) / np.maximum(1, (bad | good) @ theirs)
    support = 0.01 + np.concatenate([1 - shared.max(1, keepdims=True), shared], 1)
    p = support / support.sum(1, keepdims=True)
    model = None
    for _ in range(rounds):
        w = p * counts[:, None]
        shares = (w.sum(0) + 1) / (w.sum() + kinds)
        called, passed = w.T @ bad + prior[..., 0], w.T @ good + prior[..., 1]
        alarms = called / (called + passed)
        right = (w[:, :1] * good).sum(0) + (w[:, 1:].sum(1, keepdims=True) * bad).sum(0)
        model = LabelModel(shares, alarms, (right + 1) / ((counts[:, None] * (bad | good)).sum(0) + 2))
        new = model.kinds(votes)
        if np.abs(new - p).max(initial=0.0) < 1e-7:
            break
        p = new
    return model


class Features:
    """Shares of hashed word shapes in a text; repeats of a word have a bucket of their own,
    and a long shape counts piece by piece."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}
        self.long: dict[bytes, list[int]] = {}

    def _learn(self, word: bytes) -> None:
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        found = [1 + zlib.crc32(shape[i : i + SHAPE]) % (BUCKETS - 1) for i in range(0, len(shape), SHAPE)]
        self.memo[word] = found[0]
        if len(found) > 1:
            self.long[word] = found[1:]

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.long.clear()
        for w in set(words).difference(self.memo):
            self._learn(w)
        found = np.bincount(np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)), minlength=BUCKETS)
        if self.long:
            rest = [i for w in words if w in self.long for i in self.long[w]]
            found += np.bincount(np.array(rest, np.int64), minlength=BUCKETS)
        total = found.sum()
        found[0] = sum(map(eq, words, words[1:]))
        which = np.flatnonzero(found)
        return which, np.sqrt(found[which] / total)


def fit_scorer(index: list[np.ndarray], value: list[np.ndarray], target: np.ndarray, rounds: int = 300, rate: float = 0.5, shrink: float = 1e-5) -> np.ndarray:
    """Logistic weights (the last is the bias) by full gradients with adaptive steps."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    if not len(target):
        return w
    size = np.fromiter(map(len, index), np.int64, len(index))
    row, col, val = np.repeat(np.arange(len(index)), size), np.concatenate(index), np.concatenate(value)
    for _ in range(rounds):
        z = np.bincount(row, val * w[col], len(index)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) / len(index)
        slope = np.append(np.bincount(col, val * error[row], BUCKETS), error.sum()) + shrink * w
        seen += slope**2
        w -= rate * slope / np.sqrt(seen)
    return w


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray


def patterns(docs: DataFrame, text_col: str = "text") -> Column:
    @F.arrow_udf("int")
    def vote(texts: pa.Array) -> pa.Array:
        nothing_heavy()
        out, at = [], 0
        for n in part_sizes(texts):
            out += [pattern(t) for t in utf8_list(texts.slice(at, n))]
            at += n
        return pa.array(out, pa.int32())

    return vote.asNondeterministic()(F.col(text_col))


def train(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """Label model from all rows of ``docs``, scorer from about ``train_docs`` distinct texts,
    picked by a hash of the text, so however rows are dealt out the model is the same."""
    found = docs.select(patterns(docs, text_col).alias("p")).groupBy("p").count().collect()  # 3^12 rows at most
    keys = np.array([r[0] for r in found], np.int64)
    counts = np.array([r[1] for r in found], float)[np.argsort(keys)]
    keys = np.sort(keys)
    labels = fit_labels(votes_of(keys), counts, tuple(1 + FAULTS.index(x.fault) for x in LABELLERS))
    share = min(1.0, train_docs / max(1.0, counts.sum()))
    place = F.xxhash64(F.col(text_col), F.lit("quality"))
    texts = docs.select(place.alias("place"), F.col(text_col).alias("_text")).where(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30))
    sample = texts.groupBy("place").agg(F.any_value("_text").alias("_text"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, index, value, kinds = Features(), [], [], []
        for b in slices(batches, "_text"):
            for t in utf8_list(b.column("_text")):
                i, v = features(t)
                index.append(i)
                value.append(v)
                kinds.append(pattern(t))
        target = labels.posterior(votes_of(np.array(kinds, np.int64))) if kinds else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([fit_scorer(index, value, target).tolist()], pa.list_(pa.float64()))], names=["w"])

    # The sample is bounded, so one task fits it.
    row = sample.repartition(1).sortWithinPartitions("place").select("_text").mapInArrow(fit, "w array<double>").first()
    return Model(labels, np.array(row.w) if row else np.zeros(BUCKETS + 1))


def quality(spark, model: Model, text: Column) -> Column:
    """The scorer's chance that a text is good; null texts are scored as empty ones."""
    shared = spark.sparkContext.broadcast(model.weights)  # BUCKETS numbers

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        nothing_heavy()
        features, w = Features(), shared.value
        for texts in batches:
            out, at = [], 0
            for n in part_sizes(texts):
                for t in utf8_list(texts.slice(at, n)):
                    i, v = features(t)
                    z = float((w[i] * v).sum() + w[-1])
                    out.append(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))
                at += n
            yield pa.array(out, pa.float64())

    return score.asNondeterministic()(text)


def accepted(docs: DataFrame, least: float = 0.3, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` whose quality is ``least`` or more, with all their columns."""
    model = train(docs, text_col, train_docs)
    return docs.where(quality(docs.sparkSession, model, F.col(text_col)) >= least)
