"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.lineage import clear, fresh_path, left, scratch, stored

__all__ = ["clear", "fresh_path", "free_name", "heavy", "left", "nothing_heavy", "ragged", "row_id", "scratch", "slices", "stored", "text_digest", "utf8_list", "whole_text", "without"]

#: What an operator works on at a time, at most: rows, and bytes unless one row has more.
#: Spark cuts the batches that arrive at 64 MB or one row, whatever their rows.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of each batch, in order and without copying, by the bytes of a text column."""
    for b in batches:
        at = 0
        for n in part_sizes(b.column(column), rows, size):
            yield b.slice(at, n)
            at += n


def part_sizes(texts: pa.Array, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[int]:
    """How many rows belong to each part of a column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        until = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield until - at
        at = until


#: The one large object of this Python worker, by what it is.
_HEAVY: dict = {}


def heavy(key, make):
    """What ``make`` gives, kept for later tasks of this worker until one asks for another
    thing: a worker that goes through the stages of a pipeline holds one stage's at a time."""
    if key not in _HEAVY:
        _HEAVY.clear()
        _HEAVY[key] = make()
    return _HEAVY[key]


def nothing_heavy() -> None:
    """For tasks that need none."""
    _HEAVY.clear()


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_id(df: DataFrame, name: str) -> Column:
    """An id as a long; one that is no number is null."""
    return F.col(name).cast("long") if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint") else F.col(name).try_cast("long")


def utf8_list(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value, null as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length-1 of every range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def text_digest(name: str = "text") -> Column:
    return F.unhex(F.sha2(whole_text(name), 256))


def without(docs: DataFrame, gone: DataFrame, twice: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text together are not in ``gone``; of those in
    ``twice`` one row each.  Both are stored tables of ids and SHA-256 digests of texts; a
    null id is a value like any other.  They grow with ``docs``, so they are joined by
    sorting, never broadcast."""
    name, digest = free_name(docs, "_dropped"), free_name(docs, "_digest")

    def in_(table: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        table = table.toDF(name, digest).hint("merge")
        return rows.join(table, (text_digest(text_col) == table[digest]) & rows[id_col].eqNullSafe(table[name]), how)

    kept = in_(gone, "left_anti", docs)
    if twice.isEmpty():
        return kept
    mark = free_name(docs, "_mark")
    once = in_(twice, "left_semi", kept).withColumn(mark, text_digest(text_col)).dropDuplicates([id_col, mark]).drop(mark)
    return in_(twice, "left_anti", kept).unionByName(once)
