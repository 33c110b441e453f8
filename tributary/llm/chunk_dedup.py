"""Exact deduplication by content-defined chunk recipes, with SQL functions only.

A text is cut into chunks at ends that depend on content alone.  Chunks are deduplicated
once: an identifier is verified where all chunks that have it are the same bytes.  Texts are
equal exactly if their ordered identifier lists are, so only those lists move from then on,
never the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, whole_text, without

#: Where a chunk may end, best first: sentences and lines; other signs and spaces; and, in a
#: text that has none of them, after rare characters.
ENDS = (r"[.!?]\s|[。！？．｡]|\n", r"[,;:)}>\]、，；：]|\s", r"[jkqvxzJKQVXZ0347的一是不了人在有我他]")


def chunks(text: Column, least: int = 512, most: int = 4096) -> Column:
    """Each chunk ends at the first of the best ends that are found after ``least`` and
    before ``most`` characters; without any it is cut at ``most``.  Together they are the
    text."""
    tried = "|".join(rf".{{{least},{most}}}?(?:{end})" for end in ENDS)
    return F.regexp_extract_all(text, F.lit(rf"(?s){tried}|.{{1,{most}}}"), F.lit(0))


def wide_hash(chunk: Column) -> Column:
    """128 bits, of two differently seeded hashes."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


def digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


#: Identifiers in the order in which they are tried; the bytes themselves always serve.
IDENTIFIERS = (wide_hash, digest, lambda chunk: chunk)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    identifiers: tuple[Callable[[Column], Column], ...] = IDENTIFIERS,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Null texts count as empty.  Of equal texts the largest id stays; rows that repeat both id
    and text are the same document and share one decision.  Null ids never win against
    others.  Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    for identify in identifiers:
        # Each distinct chunk's bytes move once, to verify its identifier.
        distinct = texts.select(F.explode(chunks(F.col("_text"))).alias("chunk")).groupBy(identify(F.col("chunk")).alias("h"), "chunk").agg(F.count(F.lit(1)).alias("copies"))
        clashes = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if clashes.isEmpty():
            break
    cut = texts.select("_id", F.sha2("_text", 256).alias("text_sha256"), F.transform(chunks(F.col("_text")), identify).alias("recipe"))
    rows = stored(cut, "recipes")
    groups = rows.groupBy("recipe").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    joined = rows.join(stored(groups, "groups"), "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal
    texts, also where a row repeats its id."""
    with scratch(docs.sparkSession) as outliving:
        copies = exact_groups(docs, id_col, text_col).where("group_size > 1")
        copies = stored(copies.groupBy(F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("digest"), "kept").agg(F.count(F.lit(1)).alias("n")), "copies")
        gone = outliving(copies.where("not kept").select("_id", "digest"), "dropped")
        twice = outliving(copies.where("kept and n > 1").select("_id", "digest"), "repeated")
    return without(docs, gone, twice, id_col, text_col)
