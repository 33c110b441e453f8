"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A batch's new units (spaces and the word after them) are joined into one text and its
suffixes sorted by their first 16 characters.  A binary search finds each piece's range of
suffixes, that is all of its occurrences: edges from one position to another.  Sorted by
where they end in their unit, they are relaxed in that order: the encoding of a prefix ends
in exactly one piece, the one whose neighbour before it is the end of a prefix's encoding too
and doesn't merge across the boundary.  That gives the library's merges without merging.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, row_id, slices, whole_text

SPACE = "▁"
#: Pairs of neighbours that are remembered, one for each slot.
SLOTS = 1 << 20
#: Units that are remembered.
CAPACITY = 600_000


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The library's rule on a short text: join the neighbours with the best score, the first
    of equals, until none is left."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = scores.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@dataclass
class Pieces:
    """A vocabulary: pieces that occur in text, byte pieces, and what ids stand for."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_of: list[bytes]
    byte_ids: list[int]
    unit: re.Pattern


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """Reads a BPE model with byte fallback and no normalisation but the space's; any other
    model is an error."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    stated = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
    rules, trained = stated.normalizer_spec, stated.trainer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    if trained.model_type != trained.BPE or not trained.byte_fallback or not plain or trained.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback and an identity normaliser are encoded here")
    if any(p.type == p.USER_DEFINED for p in stated.pieces):
        raise ValueError("user-defined pieces are not encoded here")
    ids, scores, bytes_of, byte_ids = {}, {}, [], [0] * 256
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            bytes_of.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            bytes_of.append(b"")
        else:
            ids[p], scores[p] = i, sp.get_score(i)
            bytes_of.append(p.replace(SPACE, " ").encode())
    if any(c not in ids for p in ids for c in p):
        raise ValueError("a piece has a character that is no piece")
    # Units end where no piece can reach across: at letters next to others, and before spaces.
    others = ""
    for _ in range(2):
        unit = re.compile(rf" *(?:[^\W\d_{others}]+|(?:[^\w ]|[\d_{others}])+)| +")
        odd = [p for p in ids if len(unit.findall(p.replace(SPACE, " "))) != 1]
        others = re.escape("".join(sorted({c for p in odd for c in p if re.match(r"[^\W\d_]", c)})))
        if not odd:
            break
    else:
        unit = re.compile(r" *[^ ]+| +")
        if any(len(unit.findall(p.replace(SPACE, " "))) != 1 for p in ids):
            unit = re.compile(r"(?s).+")
    return Pieces(ids, scores, bytes_of, byte_ids, unit)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the next ``depth`` characters, by doubling."""
    rank, width = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        width *= 2
    return order


def _bound(low: np.ndarray, high: np.ndarray, before) -> np.ndarray:
    """In each range the first place where ``before`` no longer holds."""
    low, high = low.copy(), high.copy()
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) // 2
        up = before(middle, todo)
        low[todo[up]] = middle[up] + 1
        high[todo[~up]] = middle[~up]
        todo = todo[low[todo] < high[todo]]
    return low


def occurrences(text: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's range of ``order``; ``pieces`` holds a row of characters for each."""
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
    padded = np.concatenate([text, np.full(pieces.shape[1], -1, text.dtype)])
    for k in range(pieces.shape[1]):
        live = np.flatnonzero((lengths > k) & (low < high))
        if not len(live):
            break
        want = pieces[live, k]
        begin = _bound(low[live], high[live], lambda m, i: padded[order[m] + k] < want[i])
        end = _bound(begin, high[live], lambda m, i: padded[order[m] + k] <= want[i])
        low[live], high[live] = begin, end
    return low, high


class Encoder:
    def __init__(self, vocabulary: Pieces, capacity: int = CAPACITY):
        self.v, self.capacity = vocabulary, capacity
        # Only a piece that its own characters merge to can end a prefix's encoding.
        real = [p for p in vocabulary.ids if len(merged(p, vocabulary.scores)) == 1]
        self.text = dict(zip((vocabulary.ids[p] for p in real), real))
        self.piece_ids = np.array(list(self.text), np.int64)
        self.lengths = np.array([len(p) for p in real], np.int64)
        self.depth = int(self.lengths.max())
        self.rows = np.full((len(real), self.depth), -1, np.int64)
        for i, p in enumerate(real):
            self.rows[i, : len(p)] = [ord(c) for c in p]
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in real if len(p) == 1]] = True
        self.unknown = len(vocabulary.bytes_of)
        self.pairs = np.full(SLOTS, -1, np.int64)
        self.fine = np.zeros(SLOTS, bool)
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, bytes] = {}

    def _apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the two pieces next to each other stay two; remembered by pair."""
        key = first << 32 | second
        slot = (first * 40_503 + second) % SLOTS
        never = (first >= self.unknown) | (second >= self.unknown)
        known = never | (self.pairs[slot] == key)
        out = never | self.fine[slot]
        new, at = np.unique(key[~known], return_inverse=True)
        if len(new):
            text, scores = self.text, self.v.scores
            fine = np.zeros(len(new), bool)
            for i, k in enumerate(new.tolist()):
                a, b = text[k >> 32], text[k & 0xFFFFFFFF]
                fine[i] = merged(a + b, scores) == [a, b]
            out[~known] = fine[at]
            place = ((new >> 32) * 40_503 + (new & 0xFFFFFFFF)) % SLOTS
            self.pairs[place], self.fine[place] = new, fine
        return out

    def solve(self, units: list[str]) -> list[np.ndarray]:
        """The ids of each unit, spaces as they are in pieces."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        joined = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", "<u4").astype(np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        inside = np.ones(len(joined), bool)
        inside[begin + sizes] = False
        code = np.where(inside, joined + 1, 0)  # 0 between units only
        order = suffix_order(np.unique(code, return_inverse=True)[1], self.depth)
        present = np.zeros(0x110002, bool)
        present[code] = True
        alive = np.flatnonzero((present[self.rows + 1] | (self.rows < 0)).all(1))
        low, high = occurrences(code, order, self.rows[alive] + 1, self.lengths[alive])
        found = high - low
        start = order[ragged(low, found)]
        length = np.repeat(self.lengths[alive], found)
        piece = np.repeat(self.piece_ids[alive], found)
        odd = np.flatnonzero(inside & ~self.single[joined])  # characters outside the vocabulary
        start, length = np.concatenate([start, odd]), np.concatenate([length, np.ones(len(odd), np.int64)])
        piece = np.concatenate([piece, np.full(len(odd), self.unknown)])
        unit = np.repeat(np.arange(len(units)), sizes + 1)
        end = start + length
        rel = end - begin[unit[start]]
        by_end = np.argsort(rel, kind="stable")
        start, end, piece, rel = start[by_end], end[by_end], piece[by_end], rel[by_end]
        last = np.full(len(joined) + 1, -1, np.int64)  # the piece that ends here
        back = np.zeros(len(joined) + 1, np.int64)
        cuts = np.flatnonzero(np.diff(rel)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rel)]):
            s, t = start[a:b], piece[a:b]
            before = last[s]
            first = before < 0
            good = first.copy()
            good[~first] = self._apart(before[~first], t[~first])
            last[end[a:b][good]], back[end[a:b][good]] = t[good], s[good]
        chosen = np.zeros(len(joined) + 1, bool)
        here, stop = (begin + sizes)[sizes > 0], begin[sizes > 0]
        while len(here):
            chosen[here] = True
            here = back[here]
            more = here > stop
            here, stop = here[more], stop[more]
        ends = np.flatnonzero(chosen)
        ids, owner = last[ends], unit[ends - 1]
        count = np.bincount(owner, minlength=len(units))
        out = np.split(ids.astype(np.uint32), np.cumsum(count)[:-1]) if len(units) else []
        for i in sorted(set(owner[ids == self.unknown].tolist())):
            at = ends[owner == i] - 1
            flat: list[int] = []
            for x, p in zip(out[i].tolist(), at.tolist()):
                flat += [self.v.byte_ids[y] for y in chr(joined[p]).encode("utf-8", "surrogatepass")] if x == self.unknown else [x]
            out[i] = np.array(flat, np.uint32)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > self.capacity:
            self._clear()
        memo, unit = self.memo, self.v.unit
        units = [unit.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = list({u for us in units for u in us if u not in memo})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            for u, ids in zip(part, self.solve([u.replace(" ", SPACE) for u in part])):
                memo[u] = ids.astype("<u4").tobytes()
        get = memo.__getitem__
        return [b"".join(map(get, us)) for us in units]


def decode(v: Pieces, ids: np.ndarray) -> str:
    """Pieces and bytes together are UTF-8; the space that encoding put in front goes."""
    raw = b"".join(map(v.bytes_of.__getitem__, ids.tolist()))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(load(path))


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each whole text's piece ids.  Null texts count as empty and have none;
    repeated rows and null ids keep a row each; other columns are not read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            ids = [np.frombuffer(x, "<u4") for x in encoder(model_path).encode(b.column("_text").to_pylist())]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["_id", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def encoded_and_decoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_pieces, ids_crc32, decoded_sha256, round_trip) for each row:
    round_trip says that decoding gives the text again, with spaces for the piece sign."""
    names = ["_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            texts = b.column("_text").to_pylist()
            ids = encoder(model_path).encode(texts)
            back = [decode(load(model_path), np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("_id"),
                    b.column("n_bytes"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([t.replace(SPACE, " ") == d for t, d in zip(texts, back)], pa.bool_()),
                ],
                names=names,
            )

    rows = docs.select(row_id(docs, id_col).alias("_id"), whole_text(text_col).alias("_text")).withColumn("n_bytes", F.octet_length("_text").cast("long"))
    return rows.mapInArrow(work, "_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean").withColumnRenamed("_id", id_col)
