"""Cross-fitted models: Spark ML pipelines, closed-form ridge, pooled and dose-response fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.ordering import attach, attach_scalar, dealt, exact_quantiles, reread
from statewise.operators.metrics import regression_metrics, split_conformal
from statewise.operators.ranks import tail_class, zscore_within
from statewise.operators.regression import _square, moments, predict
from statewise.session import cut_lineage


def cross_fit(df: DataFrame, fold: str, folds: Sequence[int], make: Callable[[DataFrame], object], key: Sequence[str], out: str = "prediction", probability: bool = False) -> DataFrame:
    """Train on the other folds, predict the held-out one, for a fixed fold list.

    ``make(train)`` returns an unfitted Pipeline. Every row lands in exactly one
    fold, so predictions are complete by construction; a fold value outside the
    list fails the query.
    """
    df = cut_lineage(df)  # read once per fold
    score = (lambda p: vector_to_array("probability")[1]) if probability else (lambda p: F.col("prediction"))
    parts = None
    for f in folds:
        model = make(df.filter(F.col(fold) != f)).fit(df.filter(F.col(fold) != f))
        part = model.transform(df.filter(F.col(fold) == f)).select(*key, score(None).alias(out))
        parts = part if parts is None else parts.unionByName(part)
    strays = F.assert_true(F.col(fold).isin(*folds), F.lit("row outside the listed folds")).isNull()
    return df.filter(strays).join(parts, list(key), "left")


def preprocess(numeric: Sequence[str], categorical: Sequence[str] = (), strategy: str = "median", scale: bool = True) -> list:
    """Fold-wise imputation, scaling and one-hot stages ending in ``features``."""
    stages = [Imputer(strategy=strategy, inputCols=list(numeric), outputCols=[f"__i_{c}" for c in numeric]),
              VectorAssembler(inputCols=[f"__i_{c}" for c in numeric], outputCol="__n")]
    last = "__n"
    if scale:
        stages.append(StandardScaler(inputCol="__n", outputCol="__z", withMean=True))
        last = "__z"
    hot = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"__x_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"__x_{c}", outputCol=f"__h_{c}")]
        hot.append(f"__h_{c}")
    stages.append(VectorAssembler(inputCols=[last, *hot], outputCol="features"))
    return stages


def preprocessed(df: DataFrame, fold: str, folds: Sequence[int], stages: Callable[[], Sequence], key: Sequence[str]) -> DataFrame:
    """``features`` of every row from stages fitted on the other folds."""
    df, parts = cut_lineage(df), None
    for f in folds:
        model = Pipeline(stages=list(stages())).fit(df.filter(F.col(fold) != f))
        part = model.transform(df.filter(F.col(fold) == f)).select(*key, fold, vector_to_array("features").alias("features"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def ridge_stage(train: DataFrame, y: str, alpha: float) -> LinearRegression:
    """Ridge with penalty alpha * |b|^2 against the squared-error *sum*.

    Spark divides the penalty by n and works in a unit-sd label space, hence
    the factor sd / n.
    """
    n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop(y)).first()
    return LinearRegression(labelCol=y, regParam=alpha / n * (sd or 1.0), elasticNetParam=0.0, standardization=False, solver="normal")


def elastic_net(train: DataFrame, stages: Sequence, y: str, alpha: float, l1_ratio: float):
    """Elastic net with objective mean squared error / 2 + alpha * (l1 |b| + (1 - l1) / 2 |b|^2).

    The label is scaled to unit population sd and the two penalties adjusted.
    Returns (fitted pipeline on the scaled label, label sd).
    """
    sd = train.agg(F.stddev_pop(y)).first()[0] or 1.0
    p1, p2 = alpha * l1_ratio / sd, alpha * (1 - l1_ratio)
    model = LinearRegression(labelCol="__y", regParam=p1 + p2, elasticNetParam=p1 / (p1 + p2) if p1 + p2 else 0.0, standardization=False)
    return Pipeline(stages=[*stages, model]).fit(train.withColumn("__y", F.col(y) / sd)), sd


def choose_elastic_net(train: DataFrame, stages: Sequence, y: str, fold: str, folds: Sequence[int], alphas: Sequence[float], ratios: Sequence[float]) -> tuple[float, float, float]:
    """Nested choice of (alpha, l1 ratio) by held-out mean absolute error."""
    train = cut_lineage(train)  # read once per grid point and fold
    best = None
    for a in alphas:
        for r in ratios:
            total, rows = 0.0, 0
            for f in folds:
                model, sd = elastic_net(train.filter(F.col(fold) != f), stages, y, a, r)
                s, c = model.transform(train.filter(F.col(fold) == f)).agg(F.sum(F.abs(F.col("prediction") * sd - F.col(y))), F.count(F.lit(1))).first()
                total, rows = total + (s or 0.0), rows + c
            mae = total / max(rows, 1)
            if best is None or mae < best[0]:
                best = (mae, a, r)
    return best[1], best[2], best[0]


# ---- elastic net from fold moments --------------------------------------------------------

def descend(g: np.ndarray, c: np.ndarray, alpha: float, l1: float, tol: float = 1e-12, rounds: int = 20_000) -> np.ndarray:
    """Coefficients that minimise b'Gb/2 - c'b + alpha (l1 |b| + (1 - l1) b'b / 2), by coordinate descent."""
    b = np.zeros(len(c))
    fit = np.zeros(len(c))  # G b
    scale = max(float(np.abs(c).max(initial=0.0)), 1e-300)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(c)):
            if g[j, j] <= 0:
                continue
            left = c[j] - fit[j] + g[j, j] * b[j]
            new = np.sign(left) * max(abs(left) - alpha * l1, 0.0) / (g[j, j] + alpha * (1 - l1))
            if new != b[j]:
                moved = max(moved, abs(new - b[j]) * g[j, j])
                fit += g[:, j] * (new - b[j])
                b[j] = new
        if moved <= tol * scale:
            break
    return b


def optimality(g: np.ndarray, c: np.ndarray, b: np.ndarray, alpha: float, l1: float) -> float:
    """Largest distance of the gradient from the subdifferential of the penalty (0 at the minimum)."""
    slope = c - g @ b - alpha * (1 - l1) * b
    return float(np.where(b != 0, np.abs(slope - alpha * l1 * np.sign(b)), np.maximum(np.abs(slope) - alpha * l1, 0)).max(initial=0.0))


def standardised_moments(m: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Gram and X'y over n of standardised columns, their means and deviations, and the mean of y.

    ``m`` holds the moments of (1, x with 0 for absent, presence, y); an absent value counts
    as the mean of the present ones, so it adds nothing to the centred sums.
    """
    n = m[0, 0]
    present = m[0, 1 + p:1 + 2 * p]
    mean = np.divide(m[0, 1:1 + p], present, out=np.zeros(p), where=present > 0)
    my = m[0, -1] / n
    xx, xp, pp = m[1:1 + p, 1:1 + p], m[1:1 + p, 1 + p:1 + 2 * p], m[1 + p:1 + 2 * p, 1 + p:1 + 2 * p]
    gram = xx - xp * mean - (xp * mean).T + pp * np.outer(mean, mean)
    cross = m[1:1 + p, -1] - mean * m[1 + p:1 + 2 * p, -1] - my * (m[0, 1:1 + p] - mean * present)
    sd = np.sqrt(np.maximum(np.diag(gram) / n, 0))
    unit = np.where(sd > 1e-12, sd, 1.0)
    return gram / n / np.outer(unit, unit), cross / n / unit, mean, unit, my


def nested_elastic_net(df: DataFrame, fold: str, x: Sequence[str], y: str, alphas: Sequence[float], ratios: Sequence[float], key: Sequence[str], folds: Sequence[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elastic net for every held-out fold, penalties chosen on the other folds' inner folds.

    One aggregation gives moments by fold; the training moments of every (outer, inner)
    pair are differences of them, and every penalty is solved from those in tasks. A second
    pass over the rows adds up the absolute errors of all inner models at once; the choice
    is the lowest mean error (ties to the lower alpha, then ratio). Objective: mean squared
    error / 2 + alpha (l1 |b| + (1 - l1) |b|^2 / 2) on standardised columns. Returns
    (predictions: key, fold, y, prediction; choices: fold, alpha, l1_ratio, inner_mae,
    optimality; inner errors: fold, inner_fold, alpha, l1_ratio, mae). The models of all
    pairs, folds^2 x grid x columns numbers, travel to the tasks of the second pass.
    """
    p, grid = len(x), [(float(a), float(r)) for a in alphas for r in ratios]
    df = reread(df)
    present = df.filter(F.col(y).isNotNull()).withColumns({**{f"__x{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(x)}, **{f"__p{i}": F.col(c).isNotNull().cast("double") for i, c in enumerate(x)}})
    names = [*(f"__x{i}" for i in range(p)), *(f"__p{i}" for i in range(p))]
    per = {r[0]: _square(r.m, 2 * p + 2) for r in moments(present, [fold], names, y).collect()}  # a row for each fold
    folds = [f for f in folds if f in per]
    total = sum(per.values())
    pairs = [(f, g) for f in folds for g in folds if f != g]
    spark = df.sparkSession

    def solved(train: np.ndarray, penalties):
        gram, cross, mean, unit, my = standardised_moments(train, p)
        for a, r in penalties:
            b = descend(gram, cross, a, r)
            beta = b / unit
            yield a, r, [float(my - beta @ mean), *map(float, beta)], [float(v) for v in mean], optimality(gram, cross, b, a, r)

    def inner(part):
        for f, g in part:
            for a, r, coef, mean, off in solved(total - per[f] - per[g], grid):
                yield f, g, a, r, coef, mean

    tried = spark.sparkContext.parallelize(pairs, max(len(pairs), 1)).mapPartitions(inner).collect()
    by_fold: dict = {}
    for f, g, a, r, coef, mean in tried:
        by_fold.setdefault(g, []).append((f, a, r, coef, mean))
    tables = {g: ([(f, a, r) for f, a, r, _, _ in rows], np.array([c for *_, c, _ in rows]), np.array([m for *_, m in rows])) for g, rows in by_fold.items()}

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, rows in frame.groupby("fold"):
                if g not in tables:
                    continue
                labels, coef, mean = tables[g]
                v = rows[list(x)].to_numpy(dtype=float)
                at = np.where(np.isnan(v)[:, None, :], mean[None], v[:, None, :])
                off = np.abs(coef[:, 0] + (at * coef[None, :, 1:]).sum(axis=2) - rows["__y"].to_numpy(dtype=float)[:, None]).sum(axis=0)
                yield pd.DataFrame([(f, g, a, r, float(e), len(rows)) for (f, a, r), e in zip(labels, off)], columns=["fold", "inner_fold", "alpha", "l1_ratio", "e", "n"])

    wanted = present.select(F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in x], F.col(y).cast("double").alias("__y"))
    sums = wanted.mapInPandas(errors, "fold int, inner_fold int, alpha double, l1_ratio double, e double, n long").groupBy("fold", "inner_fold", "alpha", "l1_ratio").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    sums = cut_lineage(sums)
    mae = sums.groupBy("fold", "alpha", "l1_ratio").agg((F.sum("e") / F.sum("n")).alias("mae"))
    best = {r.fold: r.m for r in mae.groupBy("fold").agg(F.min(F.struct("mae", "alpha", "l1_ratio")).alias("m")).collect()}
    rows, models = [], {}
    for f in folds:
        if f in best:
            a, r = best[f].alpha, best[f].l1_ratio
            _, _, coef, mean, off = next(solved(total - per[f], [(a, r)]))
            models[f] = (coef, mean)
            rows.append((int(f), a, r, best[f].mae, off))
    choices = spark.createDataFrame(rows, "fold int, alpha double, l1_ratio double, inner_mae double, optimality double")
    listed = spark.createDataFrame([(int(f), c, m) for f, (c, m) in models.items()], "__f int, __c array<double>, __m array<double>")
    joined = df.join(F.broadcast(listed), df[fold].cast("int") == F.col("__f"), "left")
    value = F.col("__c")[0]
    for i, c in enumerate(x):
        value = value + F.col("__c")[i + 1] * F.coalesce(F.col(c).cast("double"), F.col("__m")[i])
    inner_errors = sums.select("fold", "inner_fold", "alpha", "l1_ratio", (F.col("e") / F.col("n")).alias("mae"))
    return joined.select(*key, fold, y, value.alias("prediction")), choices, inner_errors


def huber_stage(y: str, epsilon: float = 1.35) -> LinearRegression:
    return LinearRegression(labelCol=y, loss="huber", epsilon=epsilon, maxIter=200)


def boosted_stage(y: str, iterations: int = 250, rate: float = 0.05, depth: int = 4, seed: int = 20260912) -> GBTRegressor:
    return GBTRegressor(labelCol=y, maxIter=iterations, stepSize=rate, maxDepth=depth, seed=seed)


def balanced_logistic(train: DataFrame, stages: Sequence, y: str, c: float = 0.5):
    """Class-balanced logistic fit: weights n/(2 n_class), penalty 1/(C n)."""
    n, pos = train.agg(F.count(F.lit(1)), F.sum(F.col(y).cast("double"))).first()
    if not pos or pos == n:
        raise ValueError("training rows hold one class only")
    weighted = train.withColumn("__w", F.when(F.col(y) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))
    model = LogisticRegression(labelCol=y, weightCol="__w", regParam=1.0 / (c * n), standardization=False, maxIter=200)
    return Pipeline(stages=[*stages, model]).fit(weighted)


def logistic_cross_fit(df: DataFrame, fold: str, folds: Sequence[int], numeric: Sequence[str], categorical: Sequence[str], y: str, key: Sequence[str], c: float = 0.5) -> DataFrame:
    df = cut_lineage(df)  # read once per fold
    parts = None
    for f in folds:
        model = balanced_logistic(df.filter(F.col(fold) != f), preprocess(numeric, categorical), y, c)
        prepared, fitted = PipelineModel(model.stages[:-1]), model.stages[-1]
        # A fitted classifier holds its training summary and with it the session, which a task can't
        # take along once streams have run; the probability is a column of its coefficients instead.
        weights = F.array(*[F.lit(float(c)) for c in fitted.coefficients.toArray()])
        terms = F.zip_with(vector_to_array("features"), weights, lambda a, b: a * b)
        margin = F.aggregate(terms, F.lit(float(fitted.intercept)), lambda total, t: total + t)
        part = prepared.transform(df.filter(F.col(fold) == f)).select(*key, y, (1 / (1 + F.exp(-margin))).alias("probability"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def state_pool(df: DataFrame, fold: str, state: str, y: str, prior: float = 20.0, by: Sequence[str] = ()) -> DataFrame:
    """Fold-excluded state mean shrunk to the fold-excluded overall mean.

    Sums per (fold, state) are a tiny table; exclusion is a subtraction, so
    one aggregation and one lookup replace a model per fold.
    """
    df = reread(df)
    cells = df.groupBy(*by, fold, state).agg(F.sum(y).alias("s"), F.count(y).alias("c"))
    per_fold = cells.groupBy(*by, fold).agg(F.sum("s").alias("fs"), F.sum("c").alias("fc"))
    per_state = cells.groupBy(*by, state).agg(F.sum("s").alias("ss"), F.sum("c").alias("sc"))
    total = cells.groupBy(*by).agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    j = cells.join(per_fold, [*by, fold]).join(per_state, [*by, state])
    j = attach(j, total, by)
    overall = F.try_divide(F.col("ts") - F.col("fs"), (F.col("tc") - F.col("fc")).cast("double"))
    pooled = (F.col("ss") - F.col("s") + prior * overall) / (F.col("sc") - F.col("c") + prior)
    lookup = j.select(*by, fold, state, pooled.alias("expected"), overall.alias("global_mean"))
    return df.join(lookup, [*by, fold, state])


def transfer_phenotypes(df: DataFrame, state: str, y: str, expected: str = "expected", places: int | None = None) -> DataFrame:
    """Residual, state-scaled z and tail class of an expectation.

    ``places`` rounds the z before the classes are cut, for comparisons across engines.
    """
    out = reread(df).withColumn("residual", F.col(y) - F.col(expected))
    z = zscore_within(out, [state], "residual", 1, False, "transfer_z")
    if places is not None:
        scale = float(10**places)
        z = z.withColumn("transfer_z", F.floor(F.col("transfer_z") * scale + 0.4937) / scale)
    return tail_class(z, "transfer_z", 0.10, 0.90, (), "transfer_class")


def cross_fitted_transfer(df: DataFrame, fold: str, folds: Sequence[int], key: Sequence[str], iterations: int = 250) -> DataFrame:
    """Boosted expectation of log1p downstream counts with residual classes."""
    from statewise.functions.scalars import transfer_features

    f = transfer_features(df).withColumn("guides", F.col("guides").cast("double"))
    make = lambda train: Pipeline(stages=[*preprocess(["cis_magnitude", "log1p_base_mean", "log1p_cells", "guides"], ["state"]), boosted_stage("log1p_downstream", iterations)])
    fitted = cross_fit(f, fold, folds, make, key, "expected")
    return transfer_phenotypes(fitted, "state", "log1p_downstream")


# ridge from fold moments


def fold_moments(df: DataFrame, fold: str, x: Sequence[str], y: str) -> DataFrame:
    return moments(df, [fold], x, y)


def ridge_folds(stats: DataFrame, fold: str, x: Sequence[str], alpha: float, blocks: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Ridge on standardised features for every held-out fold and feature block
    removed, all from one small moment table: (fold, removed, coef)."""
    k = len(x) + 1
    drops = {"none": [], **(blocks or {})}
    kind = stats.schema[fold].dataType.simpleString()

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        total, n = np.sum(np.stack(f["m"].to_numpy()), axis=0), float(f["n"].sum())
        rows = []
        for held, flat, size in zip(f[fold], f["m"], f["n"]):
            full, m = _square(total - np.asarray(flat), k + 1), n - size
            mean = full[0, 1:] / m
            cov = full[1:, 1:] - m * np.outer(mean, mean)
            for name, gone in drops.items():
                use = [i for i, c in enumerate(x) if c not in gone]
                a, b = cov[np.ix_(use, use)], cov[use, k - 1]
                beta = np.zeros(k)
                beta[[i + 1 for i in use]] = np.linalg.solve(a + alpha * np.diag(np.maximum(np.diag(a) / m, 1e-12)), b)
                beta[0] = mean[k - 1] - beta[1:] @ mean[: k - 1]
                rows.append((held, name, beta))
        return pd.DataFrame(rows, columns=[fold, "removed", "coef"])

    return stats.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, f"`{fold}` {kind}, removed string, coef array<double>")


def ridge_cross_fit(df: DataFrame, fold: str, x: Sequence[str], y: str, alpha: float, blocks: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Out-of-fold ridge predictions; with ``blocks`` also one set per ablation."""
    df = reread(df)
    fits = ridge_folds(fold_moments(df, fold, x, y), fold, x, alpha, blocks)
    j = df.join(fits, fold)
    return j.withColumn("prediction", predict(j, x)).drop("coef")


def ablate(df: DataFrame, fold: str, x: Sequence[str], y: str, alpha: float, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Metrics with each feature block removed and the R2 lost."""
    preds = ridge_cross_fit(df, fold, x, y, alpha, blocks)
    m = regression_metrics(preds, ["removed"], y, "prediction", spearman=False)
    base = m.filter("removed = 'none'").agg(F.max("r2").alias("full_r2"))
    return attach_scalar(m, base).select("removed", "n", "r2", "mae", "rmse", (F.col("full_r2") - F.col("r2")).alias("r2_lost"))


def graph_readout(features: DataFrame, edges: DataFrame, targets: DataFrame, fold: str, y: str, alpha: float = 1.0, hops: int = 2) -> DataFrame:
    """Propagated node features into a cross-fitted ridge. ``targets``: node, fold, y."""
    from statewise.operators.vectors import propagate

    long = propagate(features, edges, hops)
    columns = [r[0] for r in features.select("column").distinct().orderBy("column").limit(257).collect()]
    if len(columns) > 256:
        raise ValueError("more than 256 feature columns: reduce them first")
    names = {(c, h): f"{c}_h{h}" for c in columns for h in range(hops + 1)}
    wide = long.groupBy("node").agg(*[F.coalesce(F.sum(F.when((F.col("column") == c) & (F.col("hop") == h), F.col("value"))), F.lit(0.0)).alias(n) for (c, h), n in names.items()])
    return ridge_cross_fit(targets.join(wide, "node"), fold, list(names.values()), y, alpha)


# dose response

SPLINE_PARTS = 4  # intervals between five knots


def _cardinal(u):
    """Cubic B-spline on [0, 4)."""
    p = lambda e: F.pow(e, F.lit(3))
    return (F.when((u < 0) | (u >= 4), 0.0).when(u < 1, p(u) / 6).when(u < 2, (p(u) - 4 * p(u - 1)) / 6)
            .when(u < 3, (p(4 - u) - 4 * p(3 - u)) / 6).otherwise(p(4 - u) / 6))


def _basis(family: str, dose: str) -> dict[str, Column]:
    x = F.col(dose)
    if family == "null":
        return {}
    if family == "linear":
        return {"__b0": x}
    if family == "breakpoint":
        return {"__b0": x, "__b1": F.greatest(x - F.col("dose_median"), F.lit(0.0))}
    if family == "spline":
        u = (F.least(F.greatest(x, F.col("dose_min")), F.col("dose_max") - 1e-12) - F.col("dose_min")) / F.greatest((F.col("dose_max") - F.col("dose_min")) / SPLINE_PARTS, F.lit(1e-12))
        return {f"__b{i}": _cardinal(u - i + 3) for i in range(SPLINE_PARTS + 2)}
    if family == "hill":
        return {"__b0": _hill(dose, F.col("exponent"), F.col("half"))}
    raise ValueError(family)


def _hill(dose: str, exponent: Column, half: Column) -> Column:
    v = F.greatest(F.col(dose), F.lit(0.0))
    return F.pow(v, exponent) / (F.pow(v, exponent) + F.pow(F.greatest(half, F.lit(0.01)), exponent))


HILL = [(e, h) for e in (0.5, 1.0, 2.0, 4.0) for h in ("dose_q25", "dose_median", "dose_q75")]


def dose_response(df: DataFrame, by: Sequence[str], fold: str, pair: str, guide: str, dose: str, y: str, quality: Sequence[str],
                  families: Sequence[str] = ("null", "linear", "spline", "breakpoint", "hill")) -> DataFrame:
    """Pair-centred fits per (by, held-out fold); each guide is predicted from its partner.

    Training rows are labelled with the fold they serve, so every statistic,
    basis and moment matrix is one grouped aggregation over all folds at once.
    The Hill grid is a column for each point until rows are centred on their pair, so that
    the shuffle to the pairs does not carry it; it is chosen by AIC.
    """
    heldouts = df.select(*by, F.col(fold).alias("heldout")).distinct()
    train = df.join(heldouts, list(by)).filter(F.col(fold) != F.col("heldout")) if by else attach(df, heldouts, []).filter(F.col(fold) != F.col("heldout"))
    train, df = cut_lineage(train), cut_lineage(df)  # read by every family
    served, rows = train.count(), df.count()
    keys = [*by, "heldout"]
    cuts = exact_quantiles(train, keys, dose, {"dose_q25": 0.25, "dose_median": 0.5, "dose_q75": 0.75})
    spread = train.groupBy(*keys).agg(F.min(dose).alias("dose_min"), F.max(dose).alias("dose_max"), *[F.avg(q).alias(f"__m_{q}") for q in quality], *[F.stddev_pop(q).alias(f"__s_{q}") for q in quality])
    stats = cuts.join(spread, keys)
    z = {f"__z_{q}": (F.col(q) - F.col(f"__m_{q}")) / F.when(F.col(f"__s_{q}") > 0, F.col(f"__s_{q}")).otherwise(1.0) for q in quality}
    train = train.join(stats, keys).withColumns(z)
    test = df.withColumn("heldout", F.col(fold)).join(stats, keys).withColumns(z)
    met = dealt(train.filter(F.col(pair).isNotNull()), served, *keys, pair)
    per = Window.partitionBy(*keys, pair)
    out = None
    for family in families:
        extra = ["exponent", "half"] if family == "hill" else []
        made = {f"__h{i}": _hill(dose, F.lit(e), F.col(h)) for i, (e, h) in enumerate(HILL)} if extra else _basis(family, dose)
        centred = met.withColumns(made).withColumns({f"__c_{c}": F.col(c) - F.avg(c).over(per) for c in [*made, *z, y]})
        if extra:
            points = [F.struct(F.lit(e).alias("exponent"), F.col(h).alias("half"), F.col(f"__c___h{i}").alias("__c___b0")) for i, (e, h) in enumerate(HILL)]
            centred = centred.select(*keys, *[f"__c_{c}" for c in [*z, y]], F.inline(F.array(*points))).filter(F.col("half").isNotNull())
        columns = _basis(family, dose)
        x = [*columns, *z]
        fits = _pair_fits(moments(centred, [*keys, *extra], [f"__c_{c}" for c in x], f"__c_{y}", intercept=False), [*keys, *extra], len(x), 1.0 if family == "spline" else 1e-6)
        if extra:
            fits = fits.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("aic", "exponent", "half"))).filter("__k = 1").drop("__k")
        te = test.join(fits, keys).withColumns(columns)
        scored = te.withColumn("score", predict(te, x, "coef", intercept=False)).select(*by, "heldout", pair, guide, dose, y, "score")
        part = _partner_predictions(dealt(scored, rows, *by, "heldout", pair), [*by, "heldout", pair], guide, dose, y).withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    return out


def _pair_fits(stats: DataFrame, by: Sequence[str], k: int, ridge: float) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in stats.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            coefs, aics = [], []
            for flat, n in zip(f["m"], f["n"]):
                m = _square(flat, k + 1)
                b = np.linalg.solve(m[:k, :k] + ridge * np.eye(k), m[:k, k]) if k else np.zeros(0)
                sse = m[k, k] - 2 * b @ m[:k, k] + b @ m[:k, :k] @ b
                coefs.append(b)
                aics.append(n * np.log(max(sse, 0.0) / n + 1e-12) + 2 * k)
            yield pd.DataFrame({**{c: f[c] for c in by}, "coef": coefs, "aic": aics})

    return stats.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "coef array<double>, aic double"]))


def _partner_predictions(scored: DataFrame, key: Sequence[str], guide: str, dose: str, y: str) -> DataFrame:
    """partner's response + own score - partner's score, for pairs of exactly two."""
    pairs = scored.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(guide, dose, y, "score")).alias("p"), F.max(F.struct(guide, dose, y, "score")).alias("q")).filter("__n = 2")
    one = lambda a, b: F.struct(F.col(f"{a}.{guide}").alias(guide), F.col(f"{a}.{dose}").alias(dose), F.col(f"{a}.{y}").alias("observed"),
                                (F.col(f"{b}.{y}") + F.col(f"{a}.score") - F.col(f"{b}.score")).alias("predicted"))
    return pairs.select(*key, F.explode(F.array(one("p", "q"), one("q", "p"))).alias("x")).select(*key, "x.*")


def isotonic_response(df: DataFrame, fold: str, folds: Sequence[int], dose: str, residual: str, key: Sequence[str]) -> DataFrame:
    """Increasing fit of pair-centred residuals on dose, per held-out fold."""
    model = IsotonicRegression(featuresCol=dose, labelCol=residual, predictionCol="prediction", isotonic=True)
    return cross_fit(df, fold, folds, lambda train: Pipeline(stages=[model]), key, "isotonic")


def model_comparison(preds: DataFrame, model: str, fold: str, key: Sequence[str], y: str, pred: str, baseline: str) -> DataFrame:
    """Overall metrics per model, R2 gain over the baseline, paired error test and q."""
    from statewise.operators.resample import bh_adjust
    from statewise.operators.stats import wilcoxon_paired

    preds = cut_lineage(preds.select(model, fold, *key, y, pred))  # read by every comparison
    overall = regression_metrics(preds, [model], y, pred, spearman=False).select(model, "n", "r2", "mae", "rmse")
    per_fold = regression_metrics(preds, [model, fold], y, pred, spearman=False)
    spread = per_fold.groupBy(model).agg(F.avg("r2").alias("mean_fold_r2"), (F.stddev_samp("r2") / F.sqrt(F.count("r2"))).alias("se_fold_r2"))
    base = preds.filter(F.col(model) == baseline).select(*key, F.abs(F.col(y) - F.col(pred)).alias("__be"))
    errors = preds.filter(F.col(model) != baseline).select(model, *key, F.abs(F.col(y) - F.col(pred)).alias("__e")).join(base, list(key))
    test = bh_adjust(wilcoxon_paired(errors, [model], "__be", "__e").select(model, "z", "p_value"), "p_value")
    r0 = overall.filter(F.col(model) == baseline).agg(F.max("r2").alias("__r0"))
    return attach_scalar(overall.join(spread, model).join(test, model, "left"), r0).withColumn("r2_gain", F.col("r2") - F.col("__r0")).drop("__r0")


def one_se_selection(folds: DataFrame, by: Sequence[str], model: str, metric: str) -> DataFrame:
    """Models within one standard error of the best mean (models are few)."""
    s = folds.groupBy(*by, model).agg(F.avg(metric).alias("mean_metric"), (F.stddev_samp(metric) / F.sqrt(F.count(metric))).alias("se_metric"))
    best = s.groupBy(*by).agg(F.min(F.struct((-F.col("mean_metric")).alias("m"), F.col(model).alias("name"), F.col("se_metric").alias("se"))).alias("b"))
    j = attach(s, best.select(*by, F.col("b.name").alias("best_model"), (-F.col("b.m") - F.col("b.se")).alias("threshold")), by)
    return j.select(*by, model, "mean_metric", "se_metric", "best_model", (F.col("mean_metric") >= F.col("threshold")).alias("within_one_se"))


def applicability(df: DataFrame, numeric: Sequence[str], error: str, key: Sequence[str], fold: str, folds: Sequence[int], inner: str, alphas: Sequence[float], ratios: Sequence[float],
                  alpha: float = 0.10, levels: Sequence[float] = (0.5, 0.8, 0.95)) -> tuple[DataFrame, DataFrame]:
    """Predicted absolute error with nested elastic net, conformal risk bounds
    and the bad-error threshold, per held-out fold.

    ``inner`` holds small integers: 0 marks calibration rows, the others are
    the inner folds. Returns (risk per row and level, fold table).
    """
    df = cut_lineage(df)  # read by every fold
    stages = preprocess(numeric)
    rows, table = None, []
    values = sorted(r[0] for r in df.select(inner).distinct().collect() if r[0] != 0)
    for f in folds:
        outer = df.filter(F.col(fold) != f)
        proper, calibration = outer.filter(F.col(inner) != 0), outer.filter(F.col(inner) == 0)
        a, r, mae = choose_elastic_net(proper, stages, error, inner, values, alphas, ratios)
        model, sd = elastic_net(proper, stages, error, a, r)
        score = lambda d: model.transform(d).withColumn("risk", F.col("prediction") * sd)  # noqa: B023, E731
        cal = score(calibration).select((F.col(error) - F.col("risk")).alias("residual"))
        radius = split_conformal(cal, cal, [], "residual", levels).select("level", "radius")
        bad = exact_quantiles(outer, [], error, {"bad_threshold": 1 - alpha})
        part = attach_scalar(score(df.filter(F.col(fold) == f)).select(*key, error, "risk"), bad).withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels]))).join(radius, "level")
        part = part.select(*key, F.lit(f).alias("outer_fold"), error, F.greatest("risk", F.lit(0.0)).alias("predicted_risk"), "level",
                           F.greatest(F.col("risk") - F.col("radius"), F.lit(0.0)).alias("risk_low"), (F.col("risk") + F.col("radius")).alias("risk_high"), "bad_threshold")
        rows = part if rows is None else rows.unionByName(part)
        table.append((int(f), float(a), float(r), float(mae)))
    return rows, df.sparkSession.createDataFrame(table, "outer_fold int, alpha double, l1_ratio double, inner_mae double")
