"""Regression of the index value: least squares, selection of predictors, leave-one-out.

Everything is solved from cross products, which one aggregation gives, for the whole table
or for each fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import blocks
from tributary.functions.lineage import stored
from tributary.functions.special import f_tail, t_tail


@dataclass
class Gram:
    """Cross products of (1, x..., y); the first entry is the number of rows."""

    columns: list[str]
    matrix: np.ndarray

    def less(self, x: np.ndarray, y: float) -> Gram:
        """Without one row."""
        v = np.concatenate([[1.0], x, [y]])
        return Gram(self.columns, self.matrix - np.outer(v, v))


def gram(df: DataFrame, columns: list[str], y: str) -> Gram:
    every = [F.lit(1.0), *(F.col(c) for c in columns), F.col(y)]
    p = len(every)
    r = df.na.drop(subset=[*columns, y]).agg(*(F.sum(every[i] * every[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p))).first()
    return Gram(columns, np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)], float))


def ols(g: Gram, chosen: list[str]) -> dict:
    """Coefficients with errors, t and p; R2, adjusted R2, F and its p, s, degrees of freedom."""
    at = [0, *(1 + g.columns.index(c) for c in chosen)]
    m = g.matrix
    n, xx, xy, yy = m[0, 0], m[np.ix_(at, at)], m[at, -1], m[-1, -1]
    # Scaled to a unit diagonal, so that columns of very different size lose no digits.
    size = np.sqrt(np.outer(d := np.where(np.diag(xx) > 0, np.diag(xx), 1.0), d))
    inverse = np.linalg.pinv(xx / size) / size
    beta = inverse @ xy
    dof = int(round(n)) - len(at)
    sse = max(0.0, float(yy - beta @ xy))
    sst = float(yy - m[0, -1] ** 2 / n)
    s2 = sse / dof if dof > 0 else math.nan
    se = np.sqrt(np.maximum(np.diag(inverse) * s2, 0)) if dof > 0 else np.full(len(at), math.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
    p = [t_tail(float(x), dof) if dof > 0 and math.isfinite(x) else math.nan for x in t]
    r2 = 1 - sse / sst if sst > 0 else math.nan
    k = len(chosen)
    f = (r2 / k) / ((1 - r2) / dof) if k and dof > 0 and r2 < 1 else math.nan
    return {"terms": ["intercept", *chosen], "beta": beta, "se": se, "t": t, "p": p, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / dof if dof > 0 else math.nan, "f": f, "f_p": f_tail(f, k, dof) if f == f else math.nan, "s": math.sqrt(s2) if s2 == s2 else math.nan, "dof": dof}


def forward_stepwise(g: Gram, enter: float = 0.05) -> list[str]:
    """Adds the column with the smallest p, first of equals, while it is under ``enter``."""
    chosen: list[str] = []
    while len(chosen) < len(g.columns):
        rest = [c for c in g.columns if c not in chosen]
        p = [ols(g, [*chosen, c])["p"][-1] for c in rest]
        best = min(range(len(rest)), key=lambda i: (p[i] if p[i] == p[i] else 2.0, i))
        if not p[best] < enter:
            break
        chosen.append(rest[best])
    return chosen


def vif(g: Gram, chosen: list[str]) -> dict[str, float]:
    """Variance inflation of each column among the chosen: the inverse correlations' diagonal."""
    at = [1 + g.columns.index(c) for c in chosen]
    n, sums = g.matrix[0, 0], g.matrix[0, at]
    cov = g.matrix[np.ix_(at, at)] / n - np.outer(sums, sums) / n**2
    sd = np.sqrt(np.diag(cov))
    return dict(zip(chosen, np.diag(np.linalg.pinv(cov / np.outer(sd, sd))).tolist()))


def forward_adjusted(g: Gram, most_vif: float = 5.0, gain: float = 1e-4, fallback: str | None = None) -> list[str]:
    """Adds the column that raises adjusted R2 most, by more than ``gain``, while every
    chosen column's variance inflation stays in bounds; ``fallback`` where none does."""
    chosen: list[str] = []
    best = 0.0 if fallback else -math.inf  # without a column adjusted R2 is zero
    while True:
        options = []
        for c in (c for c in g.columns if c not in chosen):
            trial = [*chosen, c]
            if max(vif(g, trial).values()) <= most_vif:
                options.append((ols(g, trial)["adj_r2"], -g.columns.index(c), c))
        if not options or max(options)[0] <= best + gain:
            return chosen or ([fallback] if fallback else [])
        best, _, c = max(options)
        chosen.append(c)


def coefficient_table(spark, fit: dict) -> DataFrame:
    rows = [(name, float(b), float(s), float(t), float(p), k) for k, (name, b, s, t, p) in enumerate(zip(fit["terms"], fit["beta"], fit["se"], fit["t"], fit["p"]))]
    return spark.createDataFrame(rows, "term string, b double, se double, t double, p double, entry_order int")


def predicted(fit: dict):
    """log10 of the index as an expression."""
    return sum((F.col(c) * float(b) for c, b in zip(fit["terms"][1:], fit["beta"][1:])), F.lit(float(fit["beta"][0])))


def smearing(df: DataFrame, fit: dict, y: str) -> float:
    """Mean of 10 to the residuals' power."""
    return df.agg(F.avg(F.pow(F.lit(10.0), F.col(y) - predicted(fit)))).first()[0]


def attribute_equation(model, fit: dict) -> list[tuple[str, float, float]]:
    """(attribute, coefficient per unit, per deviation) of an equation in components
    ``pc1``...; the intercept, per unit, comes first."""
    b = np.zeros(len(model.columns))
    for name, beta in zip(fit["terms"][1:], fit["beta"][1:]):
        b[int(name.removeprefix("pc")) - 1] = beta
    per_sd = model.vectors @ b
    per_unit = per_sd / model.sd
    intercept = float(fit["beta"][0] - (per_unit * model.mean).sum())
    return [("intercept", intercept, float(fit["beta"][0]))] + list(zip(model.columns, per_unit.tolist(), per_sd.tolist()))


def fold(g: Gram, enter: float) -> tuple[float, np.ndarray, list[str]]:
    """Components, selection and fit from a fold's cross products: intercept and coefficients
    in raw columns, and the components that were chosen."""
    n, m = g.matrix[0, 0], g.matrix[0, 1:-1] / g.matrix[0, 0]
    cov = g.matrix[1:-1, 1:-1] / n - np.outer(m, m)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    vectors = np.linalg.eigh(cov / np.outer(sd, sd))[1][:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(m))])
    # Components are a linear map of (1, x), so their products follow from it.
    load = vectors / sd[:, None]
    full = np.zeros((len(m) + 2, len(m) + 2))
    full[0, 0] = full[-1, -1] = 1
    full[1:-1, 1:-1] = load
    full[0, 1:-1] = -m @ load
    pcs = Gram([f"pc{k + 1}" for k in range(len(m))], full.T @ g.matrix @ full)
    fit = ols(pcs, forward_stepwise(pcs, enter))
    beta = np.zeros(len(m))
    for term, b in zip(fit["terms"][1:], fit["beta"][1:]):
        beta[int(term[2:]) - 1] = b
    raw = load @ beta
    return float(fit["beta"][0] - m @ raw), raw, fit["terms"][1:]


def leave_one_out(df: DataFrame, key: str, columns: list[str], y: str, enter: float = 0.05) -> DataFrame:
    """(key, observed, estimate, predictors): each row predicted from all others, with
    standardising, components, selection, fit and smearing done anew for its fold.

    Folds work on the whole table's cross products less their own row.  The smearing factor
    is a sum over all rows for each fold, which pairs of blocks add up.
    """
    rows = stored(df.select(key, *columns, y).na.drop(), "index-rows")
    whole = gram(rows, columns, y)
    kind = dict(df.dtypes)[key]

    def fit(batches):
        for part in batches:
            out = []
            for name, row, obs in zip(part[key], part[columns].to_numpy(float), part[y]):
                start, raw, terms = fold(whole.less(row, obs), enter)
                out.append((name, obs, start, raw.tolist(), start + float(raw @ row), ";".join(terms)))
            yield pd.DataFrame(out, columns=[key, "obs", "start", "raw", "line", "predictors"])

    folds = stored(blocks.spread(rows, key).mapInPandas(fit, f"{key} {kind}, obs double, start double, raw array<double>, line double, predictors string"), "folds")

    def residuals(x: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        line = x["start"].to_numpy()[:, None] + np.stack(x["raw"]) @ z[columns].to_numpy(float).T
        factor = 10 ** (z[y].to_numpy()[None] - line)
        factor[x[key].to_numpy()[:, None] == z[key].to_numpy()[None]] = 0
        return pd.DataFrame({key: x[key], "smear": factor.sum(1)})

    smear = blocks.against(folds.select(key, "start", "raw"), rows, key, key, residuals, f"{key} {kind}, smear double").groupBy(key).agg(F.sum("smear").alias("smear"))
    power = F.pow(F.lit(10.0), F.col("line")) * F.col("smear") / (whole.matrix[0, 0] - 1)
    return folds.join(smear, key).select(key, F.pow(F.lit(10.0), F.col("obs")).alias("observed"), power.alias("estimate"), "predictors")


def leave_one_out_summary(folds: DataFrame) -> DataFrame:
    """One row: folds, R2 on log10 of the index, and the share of folds that chose the most
    common set of predictors, with that set."""
    o, e = F.log10("observed"), F.log10("estimate")
    sums = folds.agg(F.count(F.lit(1)).alias("folds"), (1 - F.sum((o - e) ** 2) / (F.var_pop(o) * F.count(F.lit(1)))).alias("r2_log10"))
    sets = folds.groupBy("predictors").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "predictors").limit(1)
    return sums.crossJoin(sets).select("folds", "r2_log10", F.col("predictors").alias("common_predictors"), (F.col("n") / F.col("folds")).alias("agreement"))  # one row each


def simple_leave_one_out(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One predictor: leave-one-out estimates in closed form, from sums less the row's own."""
    df = df.select(key, x, y).na.drop(subset=[x, y])
    s = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(k) for k, e in (("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) * F.col(x)), ("sxy", F.col(x) * F.col(y)))))
    d = df.join(F.broadcast(s))
    n, sx, sy = F.col("n") - 1, F.col("sx") - F.col(x), F.col("sy") - F.col(y)
    sxx, sxy = F.col("sxx") - F.col(x) * F.col(x), F.col("sxy") - F.col(x) * F.col(y)
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    return d.select(key, ((sy - slope * sx) / n + slope * F.col(x)).alias("estimate"), F.col(y).alias("observed"))


def partial_residuals(df: DataFrame, fit: dict, term: str, y: str):
    """Component and residual of one term, for its partial regression plot."""
    b = float(fit["beta"][fit["terms"].index(term)])
    return df.withColumn("component_residual", b * F.col(term) + F.col(y) - predicted(fit))
