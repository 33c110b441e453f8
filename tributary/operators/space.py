"""Attribute space: standard scores, principal components, distances and neighbours."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import blocks, cells
from tributary.functions.lineage import scratch, stored

#: Points are alike if so many digits are; means' last ones differ from copy to copy.
ALIKE = 9
#: Rows that are followed by themselves the other way round; few, as Snappy looks less and less
#: closely the longer nothing repeats.
BOTH_WAYS = 16
#: Combinations of values of pairs that a round of ranking takes, about; 24 bytes each.
RANKED = 1 << 26


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation."""
    stats = df.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns)).first()
    return df.select(*(c for c in df.columns if c not in columns), *(((F.col(c) - stats[c]["m"]) / (stats[c]["s"] or None)).alias(c) if stats[c]["s"] else F.lit(None).cast("double").alias(c) for c in columns))


@dataclass
class Components:
    """Means, population deviations, eigenvalues in descending order and eigenvectors."""

    columns: list[str]
    mean: np.ndarray
    sd: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def share(self) -> np.ndarray:
        return self.values / self.values.sum()

    def needed(self, target: float = 0.85) -> int:
        """Components up to the first that reaches the target."""
        return int(np.searchsorted(np.cumsum(self.share), target) + 1)

    @property
    def loadings(self) -> np.ndarray:
        return self.vectors * np.sqrt(np.maximum(self.values, 0))


def components(df: DataFrame, columns: list[str]) -> Components:
    """From one aggregation of means and cross products; the p by p problem is the driver's.

    Scores have population deviations, eigenvalues n-1, so they add up to p n / (n - 1).  Of
    each vector the entry that is largest in size is positive.  Columns without variance are
    left out; columns that follow from others give eigenvalues of 0.
    """
    p = len(columns)
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns))]
    aggs += [F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    r = df.na.drop(subset=columns).agg(*aggs).first()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    varies = np.diag(cov) > 0
    if not varies.all():
        if not varies.any():
            raise ValueError(f"none of {columns} varies")
        return components(df.na.drop(subset=columns), [c for c, v in zip(columns, varies) if v])
    sd = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd) * r["n"] / (r["n"] - 1))
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(p)])
    return Components(columns, np.array([r[f"m{i}"] for i in range(p)], float), sd, values, vectors * signs)


def scores(df: DataFrame, model: Components, keep: list[str], prefix: str = "pc") -> DataFrame:
    """Projects rows with the model's own means and deviations; an expression, no UDF."""
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(model.columns, model.mean, model.sd)]
    return df.select(*keep, *(sum((x * float(v) for x, v in zip(z, model.vectors[:, k])), F.lit(0.0)).alias(f"{prefix}{k + 1}") for k in range(len(model.columns))))


def variance_table(spark, model: Components) -> DataFrame:
    rows = [(k + 1, float(v), float(s), float(c), bool(v > 1)) for k, (v, s, c) in enumerate(zip(model.values, model.share, np.cumsum(model.share)))]
    return spark.createDataFrame(rows, "pc int, eigenvalue double, share double, cumulative double, over_one boolean")


def loading_table(spark, model: Components, target: float = 0.85) -> DataFrame:
    """Loadings, their rank within a component, and communalities over the kept ones."""
    load, k = model.loadings, model.needed(target)
    com = (load[:, :k] ** 2).sum(1)
    rows = [(f, j + 1, float(load[i, j]), float(com[i])) for i, f in enumerate(model.columns) for j in range(load.shape[1])]
    t = spark.createDataFrame(rows, "attribute string, pc int, loading double, communality double")
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("pc").orderBy(F.desc(F.abs("loading")), "attribute")))


def distances(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All pairs, both ways and with themselves: as many rows as the matrix has.  Points that
    are alike lie side by side in their blocks, so equal distances follow each other.  A
    distance is worked out once, and ``BOTH_WAYS`` rows at a time are followed by the same rows
    the other way round, so a file holds each distance once where it is compressed."""
    rows = df.select(key, *columns).na.drop()
    kind = dict(df.dtypes)[key]
    near = blocks.ordered(rows, *(F.round(c, ALIKE) for c in columns), F.col(key))
    near = stored(near.withColumn("_block", F.monotonically_increasing_id()), "numbered")

    def both(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                x, y = (np.stack([r[f"{side}{c}"] for c in columns], 1).astype(float) for side in ("_l_", "_r_"))
                d = blocks.distances(x, y).ravel()
                i, j = np.divmod(np.arange(d.size), len(y))
                out = {"station": r[f"_l_{key}"][i], "neighbour": r[f"_r_{key}"][j], "distance": d}
                if r["_l__block"] != r["_r__block"]:
                    back = {"station": out["neighbour"], "neighbour": out["station"], "distance": d}
                    whole = d.size // BOTH_WAYS * BOTH_WAYS
                    woven = lambda a, b: np.concatenate([np.stack([a[:whole].reshape(-1, BOTH_WAYS), b[:whole].reshape(-1, BOTH_WAYS)], 1).ravel(), a[whole:], b[whole:]])  # noqa: E731, B023
                    out = {c: woven(out[c], back[c]) for c in out}
                yield pd.DataFrame(out)

    return blocks.paired(near, near, "_l__block <= _r__block").mapInPandas(both, f"station {kind}, neighbour {kind}, distance double")


def within(df: DataFrame, key: str, columns: list[str], threshold: float) -> DataFrame:
    """Pairs at most ``threshold`` apart, each station with itself too."""
    return cells.within(df, key, columns, threshold)


def neighbours(df: DataFrame, key: str, columns: list[str], k: int, of: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest others with their rank; of equals the smaller key first.  For all
    stations, or those whose keys are in ``of``."""
    w = Window.partitionBy("station").orderBy("distance", "neighbour")
    return cells.nearest(df, key, columns, k, of=of).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def spearman(df: DataFrame, a: str, b: str, parts: int = 64) -> DataFrame:
    """Rank correlation with mean ranks for ties.  Distinct values are counted, dealt out in
    ranges, ranked within each, and the ranges' totals are added up: no task sorts them all."""

    def ranks(c: str, name: str) -> DataFrame:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"{name}_v")).agg(F.count(F.lit(1)).alias("m"))
        ranged = stored(counts.repartitionByRange(parts, f"{name}_v").withColumn("part", F.spark_partition_id()), "ranks")
        total = ranged.groupBy("part").agg(F.sum("m").alias("of_part"))  # a row for each range
        before = total.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))
        inside = F.sum("m").over(Window.partitionBy("part").orderBy(f"{name}_v")) - F.col("m")
        return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").select(f"{name}_v", (F.col("before") + F.col("inside") + (F.col("m") + 1) / 2).alias(name))

    both = df.join(ranks(a, "ra"), F.col(a) == F.col("ra_v")).join(ranks(b, "rb"), F.col(b) == F.col("rb_v"))
    return both.agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def _edge(place: int) -> int:
    """The least whole number of a range: 256 to each doubling, by the bits of a double."""
    return int(np.ceil(np.int64(place << 44).view(np.float64)))


def _rounds(counts: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """(low, high, before) of values that are ranked together, from (range, rows, pairs):
    about ``most`` rows each, a range at least, with the pairs of smaller values."""
    out, low, rows, pairs, before = [], None, 0, 0, 0
    for place, n, m in sorted(counts):
        if low is not None and rows + n > most:
            out.append((low, _edge(place), before))
            low, rows, before = None, 0, pairs
        low, rows, pairs = _edge(place) if low is None else low, rows + n, pairs + m
    return out if low is None else [*out, (low, 1 << 62, before)]


def _counted(distance: np.ndarray, gap: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each combination once, with how often it occurs."""
    bits = int(gap.max(initial=0)).bit_length()
    if int(distance.max(initial=0)).bit_length() + bits > 63:  # too long for one number
        both, at, copies = np.unique(np.stack([distance, gap]), axis=1, return_inverse=True, return_counts=True)
        return both[0], both[1], copies if n is None else np.bincount(at.ravel(), n).astype(np.int64)
    both = distance << bits | gap
    if n is None:
        both, copies = np.unique(both, return_counts=True)
    else:
        both, at = np.unique(both, return_inverse=True)
        copies = np.bincount(at, n).astype(np.int64)
    return both >> bits, both & ((1 << bits) - 1), copies


def _ranked(counts: DataFrame, before: int, middle: float, parts: int) -> DataFrame:
    """(v, m, rank) of counts (v, m, ...): mean ranks less the middle one.  Values are dealt
    out in ranges and ranked within each: no task sorts them all."""
    ranged = stored(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "ranks")
    total = ranged.groupBy("part").agg(F.sum("m").alias("of_part"))  # a row for each range
    earlier = total.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("earlier"))
    inside = F.sum("m").over(Window.partitionBy("part").orderBy("v")) - F.col("m")
    rank = F.lit(before) + F.col("earlier") + F.col("inside") + (F.col("m") + 1) / 2 - F.lit(middle)
    return ranged.withColumn("inside", inside).join(F.broadcast(earlier), "part").withColumn("rank", rank).drop("part", "inside", "earlier")


def pair_correlation(df: DataFrame, columns: list[str], value: str, digits: int = 9, parts: int = 64, most: int | None = None) -> DataFrame:
    """(rho, n): rank correlation, with mean ranks for ties, between the distance of two rows
    and the gap of their values, both rounded, over all pairs of rows.

    Pairs are never stored.  Pairs of blocks give each combination of distance and gap with its
    number; rows that are alike share a block, so copies add none.  Where there are more than
    ``most`` combinations, ranges of values are ranked one after another, and pairs of blocks
    are worked on anew for each: the disk holds one round, and the ranks of distinct gaps.
    """
    spark, most, unit = df.sparkSession, most or RANKED, 10.0**digits
    with scratch(spark):
        rows = stored(df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)), F.col(value).cast("double").alias("v")).na.drop(), "points")
        axes = [f"_{i}" for i in range(len(columns))]
        near = stored(blocks.ordered(rows, *(F.round(c, ALIKE) for c in ("v", *axes))).withColumn("block", F.monotonically_increasing_id()), "numbered")
        pairs = blocks.paired(near, near, "_l_block <= _r_block")
        whole = lambda x: np.floor(x * unit + 0.5).astype(np.int64)

        def combinations(batches, axis: str, low: int, high: int):
            """Combinations of pairs whose ``axis`` is in a range; of gaps alone, distances are 0."""
            held, size = [], 0
            for pdf in batches:
                for k in range(len(pdf)):
                    r = pdf.iloc[k]
                    v, w = r["_l_v"], r["_r_v"]
                    gap = whole(np.abs(v[:, None] - w[None]))
                    fine = np.triu(np.ones(gap.shape, bool), 1) if r["_l_block"] == r["_r_block"] else np.ones(gap.shape, bool)
                    if axis == "gap":
                        fine &= (gap >= low) & (gap < high)
                        d = np.zeros(int(fine.sum()), np.int64)
                    else:
                        points = (np.stack([r[f"{side}{a}"] for a in axes], 1) for side in ("_l_", "_r_"))
                        d = whole(blocks.distances(*points))
                        fine &= (d >= low) & (d < high)
                        d = d[fine]
                    held.append(_counted(d, gap[fine]))
                    size += len(held[-1][0])
                    if size > 1 << 21:
                        yield _counted(*map(np.concatenate, zip(*held)))
                        held, size = [], 0
            if size:
                yield _counted(*map(np.concatenate, zip(*held)))

        def sizes(batches):
            found = {}
            for d, g, n in combinations(batches, "both", 0, 1 << 62):
                for axis, x in (("distance", d), ("gap", g)):
                    place, at, copies = np.unique(x.astype(float).view(np.int64) >> 44, return_inverse=True, return_counts=True)
                    for p, c, m in zip(place.tolist(), copies.tolist(), np.bincount(at, n).tolist()):
                        before = found.get((axis, p), (0, 0))
                        found[axis, p] = before[0] + c, before[1] + int(m)
            yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["axis", "place", "rows", "pairs"])

        table = pairs.mapInPandas(sizes, "axis string, place long, rows long, pairs long").groupBy("axis", "place").agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs"))
        counts = table.collect()  # 256 to each doubling of a value at most
        rounds = {a: _rounds([(r.place, r.rows, r.pairs) for r in counts if r.axis == a], most) for a in ("distance", "gap")}
        n = sum(r.pairs for r in counts if r.axis == "gap")
        middle = (n + 1) / 2

        def found(axis: str, low: int, high: int) -> DataFrame:
            def each(batches):
                for d, g, m in combinations(batches, axis, low, high):
                    for at in range(0, len(d), 1 << 17):
                        yield pd.DataFrame({"d": d[at : at + (1 << 17)], "g": g[at : at + (1 << 17)], "m": m[at : at + (1 << 17)]})

            return pairs.mapInPandas(each, "d long, g long, m long")

        ranked, sums = None, [0.0, 0.0, 0.0]
        for low, high, before in rounds["gap"]:
            one = stored(_ranked(found("gap", low, high).groupBy(F.col("g").alias("v")).agg(F.sum("m").alias("m")), before, middle, parts), "gaps")
            sums[1] += one.agg(F.sum(F.col("m") * F.col("rank") ** 2)).first()[0]
            ranked = one if ranked is None else ranked.unionByName(one)
        for low, high, before in rounds["distance"]:
            with scratch(spark):
                known = found("distance", low, high).join(ranked.select(F.col("v").alias("g"), "rank"), "g")
                each = known.groupBy(F.col("d").alias("v")).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("rank")).alias("other"))
                one = _ranked(each, before, middle, parts).agg(F.sum(F.col("m") * F.col("rank") ** 2), F.sum(F.col("rank") * F.col("other"))).first()
                sums[0], sums[2] = sums[0] + one[0], sums[2] + one[1]
    spread = float(np.sqrt(sums[0]) * np.sqrt(sums[1]))
    rho = None if not n else sums[2] / spread if spread else float("nan")
    return spark.createDataFrame([(rho, n)], "rho double, n long")


def neighbour_spread(df: DataFrame, key: str, columns: list[str], values: DataFrame, value: str, k: int = 5) -> DataFrame:
    """(key, spread): population deviation of ``value`` over each station and its k - 1 nearest."""
    near = neighbours(df, key, columns, k - 1).select(F.col("station").alias(key), "neighbour")
    near = near.unionByName(df.na.drop(subset=columns).select(key, F.col(key).alias("neighbour")))
    return near.join(values.select(F.col(key).alias("neighbour"), value), "neighbour").groupBy(key).agg(F.stddev_pop(value).alias("spread"))


def _placed(ordered: DataFrame, parts: int = 64) -> DataFrame:
    """(x, place): rows with their place in the order of x, from 0, range by range."""
    ranged = stored(ordered.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()), "ranges")
    total = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("of_part"))
    before = total.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").select("x", (F.col("before") + F.col("inside")).alias("place"))


def random_spread(values: DataFrame, value: str, k: int = 5, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(rep, spread) of random sets of k stations.  Each draw takes k random places in the
    order of values; each place has a row, so the values are joined, not collected.  A draw
    has a generator of its own, so it is the same wherever it runs."""
    spark = values.sparkSession
    ordered = values.select(F.col(value).cast("double").alias("x")).na.drop()
    placed = stored(_placed(ordered), "places")
    n = placed.count()

    def work(batches):
        for pdf in batches:
            draw = lambda rep: np.random.default_rng([seed, int(rep)]).choice(n, k, replace=False)
            for rep in pdf["id"]:
                yield pd.DataFrame({"rep": rep, "place": draw(rep)})

    drawn = spark.range(reps if n >= k else 0).mapInPandas(work, "rep long, place long")
    return drawn.join(placed, "place").groupBy("rep").agg(F.stddev_pop("x").alias("spread"))


def same_distances(a: DataFrame, b: DataFrame, most: float = 1e-6) -> DataFrame:
    """One row on two tables of all pairs: symmetric, zero diagonal, and the same distances."""
    back = a.select(F.col("station").alias("neighbour"), F.col("neighbour").alias("station"), F.col("distance").alias("back"))
    both = a.join(back, ["station", "neighbour"]).join(b.withColumnRenamed("distance", "other"), ["station", "neighbour"])
    gap = lambda c: F.max(F.abs(F.col("distance") - F.col(c))) <= most
    return both.agg(gap("back").alias("symmetric"), (F.max(F.when(F.col("station") == F.col("neighbour"), F.abs("distance"))) <= most).alias("zero_diagonal"), gap("other").alias("same"), F.count(F.lit(1)).alias("pairs"))


def checked_distances(a: DataFrame, b: DataFrame, key: str, a_columns: list[str], b_columns: list[str], most: float = 1e-6, rows: int = 8192) -> DataFrame:
    """What ``same_distances`` says of all pairs of two tables of points: pairs of blocks give
    the largest gaps, not the pairs, so nothing as long as the matrix is stored."""
    mine, theirs = [f"_a{i}" for i in range(len(a_columns))], [f"_b{i}" for i in range(len(b_columns))]
    named = lambda df, columns, names: df.select(key, *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names))).na.drop()
    points = stored(named(a, a_columns, mine).join(named(b, b_columns, theirs), key), "points")

    def work(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found, there = [], y[key].to_numpy()
        ya, yb = y[mine].to_numpy(float), y[theirs].to_numpy(float)
        for at in range(0, len(x), 64):  # as many distances as the caches hold
            part = x.iloc[at : at + 64]
            xa, xb = part[mine].to_numpy(float), part[theirs].to_numpy(float)
            d = blocks.distances(xa, ya)
            own = d[part[key].to_numpy()[:, None] == there[None]]
            gap = lambda other: float(np.abs(d - other).max())
            found.append((gap(blocks.distances(ya, xa).T), float(own.max()) if len(own) else None, gap(blocks.distances(xb, yb)), d.size))
        return pd.DataFrame(found, columns=["back", "self", "other", "n"])

    gaps = blocks.against(points, points, key, key, work, "back double, self double, other double, n long", rows)
    most_ = lambda c: F.max(c) <= most
    return gaps.agg(most_("back").alias("symmetric"), most_("self").alias("zero_diagonal"), most_("other").alias("same"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs"))
