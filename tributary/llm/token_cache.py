"""Token counts through a digest cache.

``count_tokens`` joins each text's content digest and the tokenizer file's digest to counts
that earlier calls stored, lets the tokenizer see only the distinct texts that are missing,
and appends their counts to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, whole_text
from .vocab import tokenizer

CACHE = T.StructType(
    [
        T.StructField("content_digest", T.BinaryType()),
        T.StructField("tokenizer_digest", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark, cache_path: str) -> DataFrame | None:
    """None where nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    Null texts count as empty (0 bytes, 0 tokens).  Repeated rows and null ids keep a row
    each.  Equal texts are encoded once; a text in the cache is not encoded.  Other columns
    of ``docs`` are not read.  The cache is only ever appended to: writers at the same time,
    or one that is tried again, may store an entry twice, which does no harm.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    keyed = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).withColumn(
        "content_digest", F.unhex(F.sha2("_text", 256))
    )
    distinct = keyed.groupBy("content_digest").agg(F.any_value("_text").alias("_text"))
    cache = read_cache(spark, cache_path)
    if cache is not None:
        known = cache.where(F.col("tokenizer_digest") == version).select("content_digest")
        distinct = distinct.join(known, "content_digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            counts = tokenizer(tokenizer_path).count(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("content_digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=CACHE.fieldNames(),
            )

    distinct.select("content_digest", "_text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    counts = counts.groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))
    return (
        keyed.select("_id", "content_digest", F.octet_length("_text").cast("long").alias("n_bytes"))
        .join(counts, "content_digest")
        .select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
