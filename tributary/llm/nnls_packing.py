"""Packing of token sequences by non-negative least squares.

Each document gives whole windows and a rest.  A histogram of all rests, in bins of
``window / BINS`` ids, is the right-hand side; the columns are the combinations of up to
three bins that fill a window.  Non-negative least squares gives how often each combination
should be used; each chunk of documents uses its rounded share of those counts, fills the
gaps that binning leaves, and packs what remains greedily, cutting where a window ends.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, slices, stored, whole_text
from .vocab import tokenizer

BINS = 64
#: A task packs so many ids at a time.
CHUNK_IDS = 4_000_000


def combinations(bins: int = BINS) -> list[tuple[int, ...]]:
    """Up to three bins, in descending order, whose sizes add up to a window."""
    out: list[tuple[int, ...]] = [(bins,)]
    for a in range(bins - 1, 0, -1):
        for b in range(min(a, bins - a), 0, -1):
            c = bins - a - b
            if c == 0:
                out.append((a, b))
            elif c <= b:
                out.append((a, b, c))
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Least squares of ``a @ x - b`` over ``x >= 0``, by an active set."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[k] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            down = free & (z <= 1e-12)
            if not down.any():
                break
            gap = x[down] - z[down]
            step = np.min(np.divide(x[down], gap, out=np.zeros_like(gap), where=gap > 0))
            x += step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
        x = z
    return x


def solve(histogram: np.ndarray) -> list[tuple[tuple[int, ...], float]]:
    """Combinations and repeat counts for a histogram of rests (index 0: bin 1)."""
    combos = combinations(len(histogram))
    a = np.zeros((len(histogram), len(combos)))
    for j, combo in enumerate(combos):
        for k in combo:
            a[k - 1, j] += 1
    x = nnls(a, histogram.astype(float))
    return sorted(((c, float(v)) for c, v in zip(combos, x) if v > 0), key=lambda t: -t[1])


class _Sequences:
    """Pieces as (document, start, length, sequence, offset), sequence by sequence."""

    def __init__(self, window: int):
        self.window, self.pieces, self.number, self.filled = window, [], 0, 0

    def put(self, doc: int, start: int, length: int) -> int:
        """Puts what fits and returns its length; a full window is closed."""
        n = min(length, self.window - self.filled)
        self.pieces.append((doc, start, n, self.number, self.filled))
        self.filled += n
        if self.filled == self.window:
            self.close()
        return n

    def close(self) -> None:
        if self.filled:
            self.number, self.filled = self.number + 1, 0


def place(lengths: list[int], window: int, recipe: list[tuple[tuple[int, ...], float]], total: float) -> list[tuple[int, int, int, int, int]]:
    """Every id of documents of these lengths in one piece of one sequence.

    ``recipe`` and ``total`` are the solved counts and the number of rests that they are for.
    All sequences but the last few are full; what is left after them is cut at powers of two,
    so no sequence needs padding.
    """
    out = _Sequences(window)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    rests = 0
    unit = -(-window // BINS)
    for doc, n in enumerate(lengths):
        whole = n - n % window
        for at in range(0, whole, window):
            out.put(doc, at, window)
        if n > whole:
            bins.setdefault(-(-(n - whole) // unit), []).append((doc, whole, n - whole))
            rests += 1
    planned = []
    for combo, count in recipe:
        need = Counter(combo)
        times = min(round(count * rests / max(total, 1.0)), *(len(bins.get(k, ())) // m for k, m in need.items()))
        planned += [[bins[k].pop() for k in combo] for _ in range(times)]
    residual = [x for k in sorted(bins) for x in bins[k]]  # the largest are at the end
    spare = sum(n for _, _, n in residual)
    stream: list[tuple[int, int, int]] = []
    for pieces in planned:
        gap = window - sum(n for _, _, n in pieces)
        if gap > spare:  # nothing is left to fill it with
            stream += pieces
            continue
        spare -= gap
        for piece in pieces:
            out.put(*piece)
        while out.filled:  # the gap that binning leaves
            doc, start, n = residual.pop()
            taken = out.put(doc, start, n)
            if taken < n:
                residual.append((doc, start + taken, n - taken))
    stream += residual[::-1]  # greedily, in turn, cut where a window ends
    left = sum(n for _, _, n in stream)
    stream.reverse()
    while left:
        size = window if left >= window else 1 << left.bit_length() - 1
        want = size
        while want:
            doc, start, n = stream.pop()
            take = min(n, want)
            out.put(doc, start, take)
            if take < n:
                stream.append((doc, start + take, n - take))
            want -= take
        out.close()
        left -= size
    return out.pieces


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, doc_tokens, ids): each whole text's ids and the end id, as little-endian
    unsigned 32-bit integers, stored in the shared folder."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in tokenizer(tokenizer_path).encode(b.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["_id", "doc_tokens", "ids"],
            )

    rows = docs.select(row_id(docs, id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return stored(rows.mapInArrow(encode, "_id long, doc_tokens long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Null texts count as empty and hold the end id alone; null and repeated ids keep their own
    rows; an empty table gives no rows.  ``window`` is a power of two.  Sequence ids are
    unique, not dense.  Other columns are not read.
    """
    tokens = token_table(docs, tokenizer_path, end_id, id_col, text_col)
    unit = -(-window // BINS)
    rest = F.col("doc_tokens") % window
    counts = tokens.where(rest > 0).groupBy(F.ceil(rest / unit).cast("int").alias("bin")).count().collect()  # BINS rows at most
    histogram = np.zeros(BINS)
    for k, n in counts:
        histogram[k - 1] = n
    total = float(histogram.sum())
    recipe = solve(histogram) if total else []
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
        ids, lengths, raw, held = [], [], [], 0
        for b in slices(batches, "ids"):
            for one, n, data in zip(*(b.column(c).to_pylist() for c in ("_id", "doc_tokens", "ids"))):
                ids.append(one)
                lengths.append(n)
                raw.append(memoryview(data))
                held += n
                if held >= CHUNK_IDS:
                    yield ids, lengths, raw
                    ids, lengths, raw, held = [], [], [], 0
        if ids:
            yield ids, lengths, raw

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for ids, lengths, raw in chunks(batches):
            pieces = place(lengths, window, recipe, total)
            doc, start, length, sequence, offset = zip(*pieces)
            crc = [zlib.crc32(raw[d][4 * s : 4 * (s + n)]) for d, s, n in zip(doc, start, length)]
            columns = [[ids[d] for d in doc], start, length, crc, [lengths[d] for d in doc], [first + s for s in sequence], offset]
            first += sequence[-1] + 1
            for at in range(0, len(doc), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10_000], pa.int64()) for c in columns], names=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.mapInArrow(assign, schema).withColumnRenamed("_id", id_col)
