"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, gone through up to ``most`` times.
A document's virtual finish time is its source's words up to its end, divided by the source's
share of the budget.  All copies are range-sorted by that time and taken until the budget is
used up; a document whose finish lies beyond the budget gets the words before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

#: White space between words (fixed values).
SPACE = " \t\n\x0b\x0c\r"
#: Leading hex digits of the shuffle key that cut a source's queue into slices of their own.
SLICE_DIGITS = 3
#: Ranges of virtual time.  Every range holds about as many words, whatever the sources.
RANGES = 4096


def word_count(text: Column) -> Column:
    """Words of a text, counted without making a list of them."""
    packed = F.regexp_replace(F.ltrim(text, F.lit(SPACE)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.length(packed).cast("long")


def shuffle_key(id_col: str, text_col: str, seed: str) -> Column:
    """A key that depends on nothing but the row's id and text."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), whole_text(text_col)).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, budget, target) of (source, source_size), a row a source.

    Sources by code point, null last, take the weights in turn.  They share the sum of all
    sizes; none takes more than ``most`` times its size, and what it leaves goes to the others
    by weight.  Those that stop are the first by size per weight, so running sums find them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")
    w = sizes.withColumn("weight", weight).withColumn("_limit", F.col("source_size").cast("double") * most)
    everything = Window.partitionBy()
    first = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.select("*", F.sum("source_size").over(everything).alias("budget"), F.sum("weight").over(everything).alias("_weights"), F.coalesce(F.sum("_limit").over(first), F.lit(0.0)).alias("_before"), F.coalesce(F.sum("weight").over(first), F.lit(0.0)).alias("_gone"))
    stops = F.col("_limit") * (F.col("_weights") - F.col("_gone")) <= F.col("weight") * (F.col("budget") - F.col("_before"))
    w = w.withColumn("_stops", stops)
    spent = F.sum(F.when(F.col("_stops"), F.col("_limit")).otherwise(0.0)).over(everything)
    others = F.sum(F.when(F.col("_stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    w = w.withColumns({"_spent": spent, "_others": others})
    target = F.when(F.col("_stops"), F.col("_limit")).otherwise(F.col("weight") * (F.col("budget") - F.col("_spent")) / F.col("_others"))
    return w.select("source", "source_size", "budget", target.alias("target"))


def queued(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row a document (``nth`` of those that agree in id, text and source) with the words
    before it in its source's queue and its source's size and target; stored.

    A queue is cut into slices by its shuffle key: sums run within a slice, a source's slices
    are summed by themselves, so no source is worked on in one task."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), shuffle_key(id_col, text_col, seed).alias("key"), word_count(whole_text(text_col)).alias("size")
    )
    rows = rows.groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    in_slice = Window.partitionBy("source", "slice").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = stored(rows.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("times")).over(in_slice), F.lit(0))), "queues")

    slices = rows.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("times")).alias("words"))
    goals = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("ahead", F.coalesce(F.sum("words").over(up_to), F.lit(0))).drop("words")
    slices = slices.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    slices = stored(slices, "slices").toDF("_source", "_slice", "ahead", "source_size", "budget", "target")
    rows = rows.join(slices, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    before = F.col("within") + F.col("ahead") + (F.col("nth") - 1) * F.col("size")
    return stored(rows.select("id", "source", "key", "nth", "size", before.alias("before"), "source_size", "budget", "target"), "queued")


def merged(queue: DataFrame, most: int = 3) -> DataFrame:
    """(id, source, key, nth, epoch, finish, position, words): the mix, in order of
    ``position``, the words of the mix before a copy."""
    epochs = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch")
    copies = queue.where("size > 0 and target > 0").select("*", epochs)
    begin = F.col("epoch") * F.col("source_size") + F.col("before")
    left = F.floor("target") - begin
    finish = (begin + F.col("size")).cast("double") * F.col("budget") / F.col("target")
    copies = copies.select("id", "source", "key", "nth", "epoch", "budget", finish.alias("finish"), F.least("size", left).alias("due")).where("due > 0")
    # The sort by finish time: ranges of equal width, each sorted and summed by itself.
    copies = copies.withColumn("range", F.least(F.lit(RANGES - 1), F.floor(F.col("finish") * RANGES / F.col("budget")).cast("int")))
    in_range = Window.partitionBy("range").orderBy("finish", "key", F.col("source").asc_nulls_last(), "nth", "epoch").rowsBetween(Window.unboundedPreceding, -1)
    sums = copies.groupBy("range").agg(F.sum("due").alias("_due"))
    sums = sums.select(F.col("range").alias("_range"), F.coalesce(F.sum("_due").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    placed = copies.withColumn("_within", F.coalesce(F.sum("due").over(in_range), F.lit(0)))
    placed = placed.join(F.broadcast(sums), F.col("range") == F.col("_range"))  # at most RANGES rows
    position = F.col("_within") + F.col("_ahead")
    placed = placed.withColumn("position", position).withColumn("words", F.least("due", F.col("budget") - F.col("position")))
    return placed.where("words > 0").select("id", "source", "key", "nth", "epoch", "finish", "position", "words")


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: (id, source, epoch, finish, position, words), a row for each copy of a
    document that is taken; sort by ``position`` to write it."""
    mix = merged(queued(docs, id_col, text_col, source_col, seed, weights, most), most)
    return mix.select(F.col("id").alias(id_col), "source", "epoch", "finish", "position", "words")


def taken(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(id, size, source_size, target, taken, copies) for each row of ``docs``.

    Null texts have no words; texts without words are never taken.  A null source is a source
    of its own, the last.  Repeated rows and null ids keep rows of their own.  The order is a
    hash of id and text, so reruns agree, whatever the partitions.  Sources, a row each, are
    ranked by one task; no other step has one.  Other columns of ``docs`` are not read.
    """
    queue = queued(docs, id_col, text_col, source_col, seed, weights, most)
    sums = merged(queue, most).groupBy("source", "key", "nth").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("copies")).toDF("_source", "_key", "_nth", "taken", "copies")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key")) & (F.col("nth") == F.col("_nth"))
    none = F.lit(0).cast("long")
    return queue.join(sums, same, "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("copies", none).alias("copies"))


def reference_sql(seed: str = "mix:") -> str:
    """The same for DuckDB, with the weights 5, 2, 1 and three times a source's size."""
    return f"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                   md5('{seed}' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::DOUBLE AS lim,
                   [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w FROM d GROUP BY source),
        r AS (
            SELECT *, (sum(source_size) OVER ())::BIGINT AS budget, sum(w) OVER () AS ws, coalesce(sum(lim) OVER f, 0) AS before, coalesce(sum(w) OVER f, 0) AS gone
            FROM s WINDOW f AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, lim * (ws - gone) <= w * (budget - before) AS stops FROM r),
        g AS (
            SELECT source, source_size, budget, CASE WHEN stops THEN lim ELSE
                   w * (budget - sum(CASE WHEN stops THEN lim ELSE 0 END) OVER ()) / sum(CASE WHEN stops THEN 0 ELSE w END) OVER () END AS target FROM c),
        q AS (
            SELECT d.*, g.source_size, g.budget, g.target, row_number() OVER (PARTITION BY d.source, key, doc_id) AS nth,
                   (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        x AS (
            SELECT q.*, epoch, (epoch * source_size + before + size)::DOUBLE * budget / target AS finish,
                   least(size, floor(target)::BIGINT - epoch * source_size - before) AS due
            FROM q, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0),
        p AS (
            SELECT *, (coalesce(sum(due) OVER (ORDER BY finish, key, source NULLS LAST, before, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS position
            FROM x WHERE due > 0),
        t AS (
            SELECT source, key, before, sum(least(due, budget - position))::BIGINT AS taken, count(*) AS copies
            FROM p WHERE position < budget GROUP BY source, key, before)
        SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken, coalesce(t.copies, 0) AS copies
        FROM q LEFT JOIN t ON q.source IS NOT DISTINCT FROM t.source AND q.key = t.key AND q.before = t.before"""
