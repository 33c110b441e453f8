"""Every row of one table against every row of another, in blocks that tasks work on.

Nothing is collected or broadcast: both tables are cut into blocks by a hash of their key,
a block is a row of arrays, and tasks read the blocks that they pair.  So what is stored and
shuffled is as long as the tables.  The result keeps what a function makes of a pair of
blocks, so sums and nearest rows need no table of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.lineage import stored

#: Rows of a block, about.
ROWS = 1024
#: Blocks of a table at least, so that small tables are worked on side by side too.
LEAST = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by their keys into parts enough for all cores.  Adaptive execution goes
    by bytes and would make one part of a small table, however long the work on a row takes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def packed(df: DataFrame, key: str, count: int) -> DataFrame:
    """A row for each block, stored: arrays of its rows' columns.  A hash of the key deals them out."""
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(count)).alias("_block")
    rows = df.select(block, F.struct(*df.columns).alias("_row")).repartition(count, "_block").groupBy("_block").agg(F.collect_list("_row").alias("_rows"))
    return stored(rows.select(*(F.col(f"_rows.{c}").alias(c) for c in df.columns)), "blocks")


def ordered(df: DataFrame, *by: Column, rows: int = ROWS) -> DataFrame:
    """Blocks of rows that follow each other in the order of ``by``, so that equal rows lie side
    by side; ``df`` should be stored, as it is counted."""
    count = max(LEAST, math.ceil(df.count() / rows))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in np.array_split(np.arange(len(pdf)), math.ceil(len(pdf) / (2 * rows))) if len(pdf) else ():
                yield pd.DataFrame({c: [pdf[c].to_numpy()[part]] for c in pdf.columns})

    schema = ", ".join(f"`{c}` array<{t}>" for c, t in df.dtypes)
    return stored(df.repartitionByRange(count, *by).sortWithinPartitions(*by).mapInPandas(cut, schema), "ordered-blocks")


def paired(left: DataFrame, right: DataFrame, condition: str = "true") -> DataFrame:
    """Each block (columns ``_l_...``) with each (``_r_...``) without a shuffle: tasks read the
    stored blocks again."""
    a, b = (df.select(*(F.col(c).alias(mark + c) for c in df.columns)) for df, mark in ((left, "_l_"), (right, "_r_")))
    return a.hint("shuffle_replicate_nl").join(b, F.expr(condition))


def worked(left: DataFrame, right: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the rows of each pair of blocks."""
    ours, theirs = left.columns, right.columns
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for values in zip(*(pdf[f"_l_{c}"] for c in ours), *(pdf[f"_r_{c}"] for c in theirs)):
                yield work(pd.DataFrame(dict(zip(ours, values))), pd.DataFrame(dict(zip(theirs, values[len(ours) :]))))[names]

    return paired(left, right).mapInPandas(each, schema)


def against(left: DataFrame, right: DataFrame, left_key: str, right_key: str, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rows: int = ROWS) -> DataFrame:
    """``work`` on each pair of blocks of about so many rows; both tables should be stored, as
    they are counted."""
    n = [max(LEAST, math.ceil(df.count() / rows)) for df in (left, right)]
    return worked(packed(left, left_key, n[0]), packed(right, right_key, n[1]), work, schema)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, column by column."""
    total = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T):
        total += (a[:, None] - b[None]) ** 2
    return np.sqrt(total)
