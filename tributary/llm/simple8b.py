"""Simple-8b word-aligned coding of token ids.

Each 64-bit word holds a 4-bit selector and as many ids as fit: 60 of one bit to one of 60
bits.  Selector 0 is an escape: the next word is one raw 64-bit value.  Ids are cut into
blocks of 128, and a segment's header keeps each block's word offset, so blocks are coded and
decoded side by side in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, row_id, slices, whole_text
from .vocab import tokenizer

# Fixed values of the format: ids per word by selector 1..14; selector 0 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BLOCK = 128
MAGIC = b"S8B1"
_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """A segment: magic, count of ids, count of blocks, block offsets in words, words."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    padded_values = np.zeros(blocks * BLOCK + max(COUNTS), np.uint64)
    padded_values[:n] = values
    if n and int(values.max()) < 1 << 16:
        bits = _BITS[padded_values]
    else:
        bits = np.zeros(len(padded_values), np.uint8)
        for k in range(64):
            bits += (padded_values >> np.uint64(k)) > 0
    # A word that starts at an id can hold c ids if none of them is too long and the block has
    # as many.  What holds c holds fewer too, so counting the c gives the widest selector.
    fits = np.zeros(blocks * BLOCK, np.uint8)
    left = np.tile(np.arange(BLOCK, 0, -1, dtype=np.int16), blocks)  # ids to the block's end
    left[-BLOCK:] -= blocks * BLOCK - n
    left = np.maximum(left, 0).astype(np.uint8)
    largest = bits  # the largest of c bit lengths from i on, got from that of a shorter run
    shorter = 1
    for c in COUNTS[::-1]:
        size, step = len(bits) - c + 1, c - shorter
        largest, shorter = np.maximum(largest[:size], largest[step : step + size]), c
        fits += (largest[: len(fits)] <= np.uint8(60 // c)) & (left >= np.uint8(c))
    choice = np.where(fits > 0, np.uint8(len(COUNTS) + 1) - fits, np.uint8(0))
    step_of = np.array([1, *COUNTS], np.int64)
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    ends = np.minimum(at + BLOCK, n)
    starts = np.zeros(n, bool)
    while len(at):
        starts[at] = True
        at = at + step_of[choice[at]]
        alive = at < ends
        at, ends = at[alive], ends[alive]
    start = np.flatnonzero(starts)
    own = start // BLOCK
    selector = choice[start]
    size = 1 + (selector == 0).astype(np.int64)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s, c in enumerate(COUNTS, 1):
        which = np.flatnonzero(selector == s)
        if len(which):
            at, width = start[which], np.uint64(60 // c)
            word = np.full(len(which), s, np.uint64) << np.uint64(60)
            for j in range(c):
                word |= padded_values[at] << np.uint64(j) * width
                at += 1
            words[place[which]] = word
    words[place[selector == 0] + 1] = values[start[selector == 0]]
    per_block = np.bincount(own, size, blocks).astype(np.int64) if blocks else np.zeros(0, np.int64)
    offsets = (np.cumsum(per_block) - per_block).astype("<u4")
    return MAGIC + np.array([n, blocks], "<u4").tobytes() + offsets.tobytes() + words.astype("<u8").tobytes()


def decode(segment: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks, as unsigned 64-bit integers."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment")
    n, blocks = np.frombuffer(segment, "<u4", 2, 4).tolist()
    offsets = np.frombuffer(segment, "<u4", blocks, 12)
    words = np.frombuffer(segment, "<u8", -1, 12 + 4 * blocks) if len(segment) > 12 + 4 * blocks else np.zeros(0, "<u8")
    last_block = blocks if last_block is None else last_block
    if first_block >= last_block:
        return np.zeros(0, np.uint64)
    words = words[offsets[first_block] : offsets[last_block] if last_block < blocks else len(words)]
    selector = (words >> np.uint64(60)).astype(np.int64)
    # The word after an escape is raw: it holds no selector.  A raw word may look like an
    # escape itself, so runs of possible escapes are read in turn.
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    count = np.array([1, *COUNTS, 0], np.int64)[selector]
    count[raw] = 0
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s, c in enumerate(COUNTS, 1):
        which = np.flatnonzero((selector == s) & ~raw)
        if len(which):
            at, word, width = begin[which], words[which], np.uint64(60 // c)
            mask = (np.uint64(1) << width) - np.uint64(1)
            for _ in range(c):
                out[at] = word & mask
                word >>= width
                at += 1
    which = np.flatnonzero((selector == 0) & ~raw)
    out[begin[which]] = words[which + 1]
    return out


SEGMENTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("ids", T.BinaryType()),
    ]
)


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each with ``end_id`` after it, in ascending id
    order: parts are ranges of ids, segments follow each other in a part.

    Null ids, and those that are no numbers, come first, equal ids in order of their text's
    digest; null texts are empty.
    Other columns are not read.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = 0
        for b in slices(batches, "_text"):
            ids = tokenizer(tokenizer_path, 1_000_000).encode(b.column("_text").to_pylist())
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
            flat = np.full(int(lengths.sum()), end_id, np.uint64)
            keep = np.ones(len(flat), bool)
            keep[np.cumsum(lengths) - 1] = False
            if ids:
                flat[keep] = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([b.column("_id").to_pylist()], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([encode(flat)], pa.binary())],
                names=SEGMENTS.fieldNames(),
            )
            before += len(flat)

    rows = docs.select(row_id(docs, id_col).alias("_id"), whole_text(text_col).alias("_text"))
    # Rows that share an id, or have none, are dealt out by their text.
    rows = rows.withColumn("_mark", F.xxhash64("_text")).repartitionByRange("_id", "_mark").sortWithinPartitions("_id", "_mark", "_text")
    rows.select("_id", "_text").mapInArrow(build, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_ids(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document of files that ``write_ids`` wrote;
    start counts the ids of all documents before it."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # One row for each part, which is a task of the writer: few, whatever the input's size.
    parts = sorted(tuple(r) for r in segments.groupBy("part").agg(F.sum("n_ids")).collect())
    base, at = [], 0
    for part, n in parts:
        base.append((part, at))
        at += n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    placed = segments.join(bases, "part").withColumn("start", F.col("base") + F.col("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids", 1):  # a segment at a time
            for start, doc_ids, lengths, ids in zip(*(b.column(c).to_pylist() for c in ("start", "doc_ids", "lengths", "ids"))):
                raw = memoryview(decode(ids).astype("<u4")).cast("B")
                ends = np.cumsum(np.array(lengths, np.int64))
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - np.array(lengths, np.int64), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.select("start", "doc_ids", "lengths", "ids").mapInArrow(read, "_id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("_id", id_col)


def coded_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes files in the shared folder and reads them back."""
    path = fresh_path(docs.sparkSession, "ids")
    write_ids(docs, tokenizer_path, path, end_id, id_col, text_col)
    return read_ids(docs.sparkSession, path, id_col)
