"""Linear models from distributed sufficient statistics.

Rows reduce to one p x p moment matrix per group in Spark; only those small
matrices are solved, each inside the task that holds its row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.functions.ordering import attach, attach_scalar
from statewise.functions.tails import NORMAL_975, normal_two_sided


def moments(df: DataFrame, by: Sequence[str], x: Sequence[str], y: str, weight: str | None = None, intercept: bool = True) -> DataFrame:
    """One row per group: n, moment matrix of (1, x..., y) as an upper triangle array."""
    columns = [*([F.lit(1.0)] if intercept else []), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    k = len(columns)
    sums = [F.sum(w * columns[i] * columns[j]) for i in range(k) for j in range(i, k)]
    return df.groupBy(*by).agg(F.sum(w).alias("n"), F.array(*sums).alias("m"))


def _square(flat, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = np.asarray(flat, dtype=float)
    return out + np.triu(out, 1).T


def solve(stats: DataFrame, by: Sequence[str], x: Sequence[str], alpha: float = 0.0, intercept: bool = True) -> DataFrame:
    """Least squares, or ridge with an unpenalised intercept, per moment row.

    Adds ``coef`` (intercept first), the inverse of X'X + alpha I and R2.
    """
    k = len(x) + int(intercept)
    penalty = alpha * np.diag([0.0] * int(intercept) + [1.0] * len(x))
    kinds = {f.name: f.dataType.simpleString() for f in stats.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            coefs, inverses, r2 = [], [], []
            for flat, n in zip(f["m"], f["n"]):
                full = _square(flat, k + 1)
                a, b, yy = full[:k, :k], full[:k, k], full[k, k]
                inv = np.linalg.pinv(a + penalty, hermitian=True)
                beta = inv @ b
                sst = yy - (full[0, k] ** 2 / n if intercept else 0.0)
                sse = yy - 2 * beta @ b + beta @ a @ beta
                coefs.append(beta)
                inverses.append(inv.ravel())
                r2.append(1 - sse / sst if sst > 0 else None)
            yield pd.DataFrame({**{c: f[c] for c in by}, "n": f["n"], "coef": coefs, "inverse": inverses, "r2": r2})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n double, coef array<double>, inverse array<double>, r2 double"])
    return stats.select(*by, "n", "m").mapInPandas(run, schema)


def predict(df: DataFrame, x: Sequence[str], coef: str = "coef", intercept: bool = True):
    """Linear predictor column from an attached coefficient array."""
    out = F.col(coef)[0] if intercept else F.lit(0.0)
    for i, c in enumerate(x):
        out = out + F.col(coef)[i + int(intercept)] * F.col(c).cast("double")
    return out


def ridge_r2(df: DataFrame, by: Sequence[str], x: Sequence[str], y: str, alpha: float) -> DataFrame:
    return solve(moments(df, by, x, y), by, x, alpha).select(*by, F.col("r2").alias("value"))


def residuals(df: DataFrame, by: Sequence[str], x: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Replace each target by its least-squares residual on x (with intercept)."""
    out = df
    for t in targets:
        fit = solve(moments(df, by, x, t), by, x).select(*by, F.col("coef").alias("__coef"))
        out = attach(out, fit, by)
        out = out.withColumn(f"{t}_residual", F.col(t) - predict(out, x, "__coef")).drop("__coef")
    return out


def ols_cluster(df: DataFrame, y: str, x: Sequence[str], cluster: str) -> DataFrame:
    """OLS with cluster-robust errors (finite-sample factor G/(G-1)*(N-1)/(N-K))."""
    k = len(x) + 1
    fit = solve(moments(df, [], x, y), [], x)
    rows = attach_scalar(df.select(cluster, y, *x), fit)
    e = F.col(y) - predict(rows, x)
    design = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    scores = rows.groupBy(cluster).agg(*[F.sum(d * e).alias(f"s{i}") for i, d in enumerate(design)])
    meat = scores.agg(F.count(F.lit(1)).alias("g"), F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(i, k)]).alias("meat"))
    terms = ["intercept", *x]

    def sandwich(frames):
        for f in frames:
            for r in f.itertuples():
                inv = np.asarray(r.inverse, dtype=float).reshape(k, k)
                factor = r.g / (r.g - 1) * (r.n - 1) / (r.n - k)
                cov = factor * inv @ _square(r.meat, k) @ inv
                yield pd.DataFrame({"term": terms, "estimate": r.coef, "se": np.sqrt(np.diag(cov)), "clusters": int(r.g)})

    out = attach_scalar(fit, meat).mapInPandas(sandwich, "term string, estimate double, se double, clusters bigint")
    return out.withColumns({
        "ci_low": F.col("estimate") - NORMAL_975 * F.col("se"), "ci_high": F.col("estimate") + NORMAL_975 * F.col("se"),
        "p_value": normal_two_sided(F.try_divide(F.col("estimate"), F.col("se")))})


def residualized_slope(df: DataFrame, y: str, x: str, nuisance: Sequence[str], cluster: str, count: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Slope of y on x given the nuisance columns, and weighted bootstrap draws
    of sum(xy)/sum(xx) over clusters of residual products."""
    from statewise.operators.resample import bootstrap_sums

    r = residuals(df, [], nuisance, [x, y])
    rx, ry = F.col(f"{x}_residual"), F.col(f"{y}_residual")
    est = r.agg((F.sum(rx * ry) / F.sum(rx * rx)).alias("estimate"), F.count(F.lit(1)).alias("n"))
    sums = bootstrap_sums(r, [], cluster, {"xy": rx * ry, "xx": rx * rx}, count, seed)
    return est, sums.select("replicate", F.try_divide(F.col("xy"), F.col("xx")).alias("value"))


def influence(df: DataFrame, y: str, x: Sequence[str], unit: str) -> DataFrame:
    """Largest leverage and Cook's distance of each unit's rows."""
    k = len(x) + 1
    fit = solve(moments(df, [], x, y), [], x)
    rows = attach_scalar(df.select(unit, y, *x), fit)
    design = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    h = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            h = h + design[i] * design[j] * F.col("inverse")[i * k + j]
    rows = rows.select(unit, "n", h.alias("h"), (F.col(y) - predict(rows, x)).alias("e"))
    mse = rows.agg((F.sum(F.col("e") * F.col("e")) / (F.max("n") - k)).alias("mse"))
    cook = F.pow("e", F.lit(2)) * F.col("h") / (k * F.col("mse") * F.pow(1 - F.col("h"), F.lit(2)))
    return attach_scalar(rows, mse).groupBy(unit).agg(F.max("h").alias("leverage"), F.max(cook).alias("cooks_distance"), F.count(F.lit(1)).alias("rows"))


def leave_unit_out_slope(df: DataFrame, y: str, x: Sequence[str], unit: str) -> DataFrame:
    """Coefficients without each unit: total moments minus the unit's moments."""
    per = moments(df, [unit], x, y)
    width = (len(x) + 2) * (len(x) + 3) // 2
    total = per.agg(F.sum("n").alias("tn"), F.array(*[F.sum(F.col("m")[i]) for i in range(width)]).alias("tm"))
    rest = attach_scalar(per, total).select(unit, (F.col("tn") - F.col("n")).alias("n"), F.zip_with("tm", "m", lambda a, b: a - b).alias("m"))
    return solve(rest, [unit], x)
