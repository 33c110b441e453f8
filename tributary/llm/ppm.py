"""Language identification by prediction with partial matching.

For each language a tree of byte contexts, of ``order`` bytes and fewer, is counted on a
bounded sample, then frozen.  A byte is coded in the longest context that has been seen; if
the byte has not been seen there, the context's escape is coded (as many chances as it has
distinct bytes, method C) and the next shorter context takes over without the bytes already
ruled out, down to all 256 bytes alike.  The language with the shortest exact code of a text
wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, nothing_heavy, part_sizes, slices, utf8_list

#: Longest context; at most 6, so that a context and its byte fit into 64 bits.
ORDER = 3
#: Expected documents of a language that are learned from, at most.
TRAIN_DOCS = 1_500
#: Languages that are learned, the most frequent ones.
LANGUAGES = 100
#: Positions that are scored at a time.
SLICE = 1 << 19
#: Bytes of code lengths that a worker remembers, about.
MEMO_BYTES = 32 << 20


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def strings(text: bytes, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, as a number; zeros come before a text."""
    a = np.frombuffer(bytes(order) + text, np.uint8).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(order + 1):
        out = out << np.uint64(8) | a[k : k + len(text)]
    return out


@dataclass
class Level:
    """Contexts of one length, in order: bytes seen after each and how many distinct ones;
    the same of the next shorter context without what this one has seen.  ``edges`` are
    contexts with a byte, and how often."""

    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    left: np.ndarray
    left_kinds: np.ndarray
    edges: np.ndarray
    times: np.ndarray


@dataclass
class Model:
    langs: list[str]
    order: int
    trees: list[list[Level]] = field(default_factory=list)  # by language, then length


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found)), np.bincount(at, minlength=len(found)).astype(float)


def tree(code: np.ndarray, count: np.ndarray, order: int) -> list[Level]:
    """From counted strings of order + 1 bytes."""
    levels: list[Level] = []
    for k in range(order + 1):
        edges, times, _ = _summed(code & _mask(k + 1), count)
        contexts, total, kinds = _summed(edges >> np.uint64(8), times)
        left, left_kinds = np.zeros(len(contexts)), np.zeros(len(contexts))
        if k:
            shorter = levels[-1]
            suffix = np.searchsorted(shorter.contexts, contexts & _mask(k - 1))
            owner = np.searchsorted(contexts, edges >> np.uint64(8))
            again = shorter.times[np.searchsorted(shorter.edges, edges & _mask(k))]
            left = shorter.total[suffix] - np.bincount(owner, again, len(contexts))
            left_kinds = shorter.kinds[suffix] - kinds
        levels.append(Level(contexts, total, kinds, left, left_kinds, edges, times))
    return levels


def freeze(langs: list[str], lang: np.ndarray, code: np.ndarray, count: np.ndarray, order: int) -> Model:
    """From the counts of strings: language number, string, times."""
    return Model(langs, order, [tree(code[lang == k].astype(np.uint64), count[lang == k].astype(float), order) for k in range(len(langs))])


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def code_lengths(levels: list[Level], code: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each string after the others, in one language."""
    bits = np.zeros(len(code))
    todo = np.arange(len(code))
    first = np.ones(len(code), bool)  # no context has been seen so far
    total, kinds = np.zeros(len(code)), np.zeros(len(code))
    for k in range(len(levels) - 1, -1, -1):
        m = levels[k]
        at, seen = _place(m.contexts, code[todo] >> np.uint64(8) & _mask(k))
        here, at = todo[seen], at[seen]
        if not len(here):
            continue
        total[here] = np.where(first[here], m.total[at], total[here])
        kinds[here] = np.where(first[here], m.kinds[at], kinds[here])
        first[here] = False
        some = kinds[here] > 0  # else all bytes of this context are ruled out
        edge, found = _place(m.edges, code[here] & _mask(k + 1))
        found &= some
        chances = np.where(found, m.times[edge], np.where(some, kinds[here], 1.0))
        bits[here] += np.where(some, np.log2(np.maximum(total[here] + kinds[here], 1.0)) - np.log2(chances), 0.0)
        total[here], kinds[here] = m.left[at], m.left_kinds[at]
        done = np.zeros(len(code), bool)
        done[here[found]] = True
        todo = todo[~done[todo]]
    bits[todo] += np.log2(max(1, 256 - (len(levels[0].edges) if levels else 0)))
    return bits


class Scorer:
    """Exact code lengths of whole texts in every language.  The lengths of a string are
    remembered in one place each, which another string may take over."""

    def __init__(self, model: Model):
        self.model = model
        self.slots = 1 << max(10, (MEMO_BYTES // (4 * max(1, len(model.langs)))).bit_length() - 1)
        self.key = np.full(self.slots, np.iinfo(np.uint64).max, np.uint64)
        self.cost = np.zeros((self.slots, len(model.langs)), np.float32)

    def _costs(self, code: np.ndarray) -> np.ndarray:
        mixed = code * np.uint64(0x9E3779B97F4A7C15)
        slot = (mixed >> np.uint64(64 - (self.slots.bit_length() - 1))).astype(np.int64)
        out = self.cost[slot]
        miss = np.flatnonzero(self.key[slot] != code)
        if len(miss):
            new, first, at = np.unique(code[miss], return_index=True, return_inverse=True)
            costs = np.stack([code_lengths(t, new) for t in self.model.trees], 1).astype(np.float32)
            out[miss] = costs[at]
            place = slot[miss][first]
            self.key[place], self.cost[place] = new, costs
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Of each text in each language."""
        out = np.zeros((len(texts), len(self.model.langs)))
        held, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), SLICE):
                before = t[max(0, at - self.model.order) : at].rjust(self.model.order, b"\0")
                part = t[at : at + SLICE]
                held.append((i, before, part))
                size += len(part)
                if size >= SLICE:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, bytes, bytes]], out: np.ndarray) -> None:
        if not held:
            return
        order = self.model.order
        joined = b"".join(x for _, before, part in held for x in (before, part))
        code = strings(joined, order)
        sizes = np.array([len(part) for _, _, part in held])
        begin = np.cumsum(sizes + order) - sizes
        inside = np.ones(len(joined), bool)
        for k in range(1, order + 1):
            inside[begin - k] = False
        costs = self._costs(code[inside])
        starts = np.cumsum(sizes) - sizes
        np.add.at(out, np.array([i for i, _, _ in held]), np.add.reduceat(costs, starts, axis=0, dtype=np.float64))


def scorer_of(model: Model) -> Scorer:
    """One for each Python worker and model."""
    if "_scorer" not in model.__dict__:
        model._scorer = Scorer(model)
    return model._scorer


def train(
    rows: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    docs_per_lang: int = TRAIN_DOCS,
    languages: int = LANGUAGES,
    order: int = ORDER,
) -> Model:
    """Learns from ``rows`` with a language and a text: about ``docs_per_lang`` whole texts of
    each of the ``languages`` most frequent ones, picked by a hash of the id and the text; all
    of them where there are fewer."""
    if not 0 <= order <= 6:
        raise ValueError("contexts have 0 to 6 bytes")
    usable = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    most = usable.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages)
    found = sorted((r[0], r[1]) for r in most.collect())
    langs = [lang for lang, _ in found]
    if not langs:
        return Model([], order)
    parts = 1 << 30
    share = F.create_map(*(F.lit(x) for lang, n in found for x in (lang, int(min(1.0, docs_per_lang / n) * parts))))
    picked = usable.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(parts)) < F.try_element_at(share, F.col(lang_col)))
    number = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            keys = {}
            for t, name in zip(utf8_list(b.column("_text")), b.column("_lang").to_pylist()):
                keys.setdefault(number[name], []).append(strings(t, order))
            for k, codes in keys.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code.view(np.int64)), pa.array(n, pa.int64())], names=["k", "code", "n"])

    counts = picked.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).mapInArrow(count, "k int, code long, n long")
    table = counts.groupBy("k", "code").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    return freeze(langs, table.column("k").to_numpy(), table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy(), order)


def identify(spark, model: Model, text: Column) -> Column:
    """struct(lang_pred, score, bits_per_byte) of each text.

    ``und`` with score 0 where the text is null or has no letter, or no language was
    learned.  Equal code lengths: the first language in order.  score is the share of the
    best language among all, were each as likely beforehand.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample it is learned from
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        letter = regex.compile(r"\p{L}")
        nothing_heavy()
        scorer = scorer_of(shared.value) if shared.value.langs else None
        for whole in batches:
            rows, at = [], 0
            for n in part_sizes(whole):
                texts = whole.slice(at, n)
                at += n
                data = utf8_list(texts)
                bits = scorer.bits(data) if scorer else None
                for k, (t, raw) in enumerate(zip(texts.to_pylist(), data)):
                    if t is None or scorer is None or not letter.search(t):
                        rows.append({"lang_pred": "und", "score": 0.0, "bits_per_byte": float(bits[k].min()) / max(1, len(raw)) if scorer else None})
                        continue
                    best = int(bits[k].argmin())
                    rest = np.exp2(np.maximum(bits[k][best] - bits[k], -1000.0)).sum()
                    rows.append({"lang_pred": scorer.model.langs[best], "score": float(1 / rest), "bits_per_byte": float(bits[k][best]) / len(raw)})
            yield pa.array(rows, kind)

    return score.asNondeterministic()(text)


def accepted(docs: DataFrame, train_on: Column, most_bits: float = 7.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` in a language that was learned from the rows where ``train_on``
    holds: not ``und``, nor so long in code (bits a byte) that no language explains them."""
    model = train(docs.where(train_on), lang_col, text_col, id_col, docs_per_lang)
    name = free_name(docs, "_language")
    found = docs.withColumn(name, identify(docs.sparkSession, model, F.col(text_col)))
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.bits_per_byte") <= most_bits)).drop(name)
