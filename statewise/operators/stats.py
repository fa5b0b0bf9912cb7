"""Correlation, rank tests, exact tests, meta-analysis and contrasts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from statewise.functions.hashing import replicates
from statewise.functions.ordering import attach, attach_scalar, exact_quantiles, rank_average, tie_groups
from statewise.functions.tails import NORMAL_975, chi_square_upper, incomplete_beta, normal_two_sided, normal_upper, student_two_sided
from statewise.operators.resample import bootstrap_sums, cluster_bootstrap, interval, permutation_p, permuted_values, sign_flip_null


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, stepped back by logs."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * F.pow(z, F.lit(7)))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def correlation(df: DataFrame, by: Sequence[str], x: str, y: str, method: str = "spearman", with_p: bool = True) -> DataFrame:
    """Correlation over complete pairs with n and a t-based p; NULL below 3 rows or when constant."""
    both = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).filter(
        F.col("__x").isNotNull() & F.col("__y").isNotNull())
    if method == "spearman":
        both = rank_average(rank_average(both, by, "__x", "__a"), by, "__y", "__b").select(*by, F.col("__a").alias("__x"), F.col("__b").alias("__y"))
    flat = (F.min("__x") == F.max("__x")) | (F.min("__y") == F.max("__y"))
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(~flat & (F.count(F.lit(1)) >= 3), F.corr("__x", "__y")).alias("r"))
    if not with_p:
        return out
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return out.withColumn("p_value", student_two_sided(t, (F.col("n") - 2).cast("double")))


def spearman(df, by, x, y, with_p=True) -> DataFrame:
    return correlation(df, by, x, y, "spearman", with_p)


def kruskal(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-corrected H over average ranks, with its chi-square p."""
    ranked = rank_average(df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*by, group, value), by, value, "__r")
    per = ranked.groupBy(*by, group).agg(F.sum("__r").alias("s"), F.count(F.lit(1)).alias("c"))
    main = per.groupBy(*by).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("ss"))
    ties = ranked.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie"))
    j = attach(main, ties, by)
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)) / (1 - F.col("tie") / (n * n * n - n))
    out = j.select(*by, "n", "groups", h.alias("h"))
    return out.withColumn("p_value", chi_square_upper("h", (F.col("groups") - 1).cast("double")))


def hypergeometric_tail(k: Column, n_set: Column, n_selected: Column, n_all: Column, upper: bool = True) -> Column:
    """P(X >= k) or P(X <= k) for the overlap of a set and a selection."""
    low = F.greatest(F.lit(0), n_set + n_selected - n_all)
    high = F.least(n_set, n_selected)
    first, last = (F.greatest(k, low), high) if upper else (low, F.least(k, high))
    d = lambda c: c.cast("double")
    bottom = log_choose(d(n_all), d(n_selected))
    term = lambda i: F.exp(log_choose(d(n_set), d(i)) + log_choose(d(n_all - n_set), d(n_selected - i)) - bottom)
    total = F.aggregate(F.sequence(first, last), F.lit(0.0), lambda a, i: a + term(i))
    return F.when(first > last, 0.0).otherwise(F.least(total, F.lit(1.0)))


def fisher_enrichment(members: DataFrame, selected: DataFrame, universe: DataFrame, set_id: str = "set_id", member: str = "member", two_sided: bool = False) -> DataFrame:
    """2x2 counts, odds ratio, exact p and Haldane-corrected log-odds interval per set."""
    inside = universe.select(member).distinct().join(selected.select(member).distinct().withColumn("__s", F.lit(1)), member, "left")
    totals = inside.agg(F.count(F.lit(1)).alias("n_all"), F.coalesce(F.sum("__s"), F.lit(0)).alias("n_selected"))
    per = members.select(set_id, member).distinct().join(inside, member).groupBy(set_id).agg(F.count(F.lit(1)).alias("n_set"), F.coalesce(F.sum("__s"), F.lit(0)).alias("a"))
    j = attach_scalar(per, totals)
    a, b = F.col("a"), F.col("n_set") - F.col("a")
    c, d = F.col("n_selected") - F.col("a"), F.col("n_all") - F.col("n_set") - F.col("n_selected") + F.col("a")
    if two_sided:
        low = F.greatest(F.lit(0), F.col("n_set") + F.col("n_selected") - F.col("n_all"))
        dd = lambda x: x.cast("double")
        term = lambda i: log_choose(dd(F.col("n_set")), dd(i)) + log_choose(dd(F.col("n_all") - F.col("n_set")), dd(F.col("n_selected") - i)) - log_choose(dd(F.col("n_all")), dd(F.col("n_selected")))
        p = F.aggregate(F.sequence(low, F.least("n_set", "n_selected")), F.lit(0.0),
                        lambda acc, i: acc + F.when(term(i) <= term(F.col("a")) + 1e-7, F.exp(term(i))).otherwise(0.0))
        p = F.least(p, F.lit(1.0))
    else:
        p = hypergeometric_tail(F.col("a"), F.col("n_set"), F.col("n_selected"), F.col("n_all"))
    half = [x + 0.5 for x in (a, b, c, d)]
    log_or = F.log(half[0] * half[3] / (half[1] * half[2]))
    se = F.sqrt(1 / half[0] + 1 / half[1] + 1 / half[2] + 1 / half[3])
    return j.select(set_id, a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), F.try_divide((a * d).cast("double"), (b * c).cast("double")).alias("odds_ratio"),
                    log_or.alias("log_odds"), (log_or - NORMAL_975 * se).alias("ci_low"), (log_or + NORMAL_975 * se).alias("ci_high"), p.alias("p_value"))


@pandas_udf(DoubleType())
def binomial_upper(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) through the incomplete beta function, for any n."""
    kk, nn = k.to_numpy(dtype=float), n.to_numpy(dtype=float)
    tail = incomplete_beta(pd.Series(kk).clip(lower=1).to_numpy(), (nn - kk + 1).clip(min=1e-9), p.to_numpy(dtype=float))
    return pd.Series([1.0 if a <= 0 else float(t) for a, t in zip(kk, tail)])


def binomial_test(df: DataFrame, by: Sequence[str], hit: str, p0: float = 0.5) -> DataFrame:
    """Exact one-sided p of the number of hits among non-NULL rows."""
    agg = df.groupBy(*by).agg(F.coalesce(F.sum(F.col(hit).cast("bigint")), F.lit(0)).alias("hits"), F.count(hit).alias("n"))
    return agg.withColumn("p_value", binomial_upper("hits", "n", F.lit(p0)))


def wilcoxon_paired(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Signed-rank test of a > b: W+, normal z with tie term, one-sided p; zero differences drop."""
    d = df.select(*by, (F.col(a) - F.col(b)).alias("__d")).filter(F.col("__d") != 0).withColumn("__m", F.abs("__d"))
    ranked = rank_average(d, by, "__m", "__r")
    main = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__r"))), F.lit(0.0)).alias("w_plus"))
    ties = ranked.groupBy(*by, "__m").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie"))
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    return attach(main, ties, by).select(*by, "n", "w_plus", z.alias("z")).withColumn("p_value", normal_upper("z"))


def direction_agreement(df: DataFrame, state: str, predicted: str, observed: str) -> DataFrame:
    """Sign agreement overall (state NULL) and per state by grouping sets."""
    both = df.filter((F.col(predicted) != 0) & (F.col(observed) != 0))
    match = (F.signum(predicted) == F.signum(observed)).cast("bigint")
    per = both.groupBy(state).agg(F.count(F.lit(1)).alias("n"), F.sum(match).alias("matches"))
    return per.rollup(state).agg(F.sum("n").alias("n"), F.sum("matches").alias("matches")).withColumn("agreement", F.col("matches") / F.col("n"))


def random_effects(df: DataFrame, by: Sequence[str], effect: str, se: str) -> DataFrame:
    """DerSimonian-Laird summary per group with heterogeneity and prediction interval."""
    v = F.greatest(F.col(se) * F.col(se), F.lit(2.2250738585072014e-308))
    w = 1 / v
    s = df.withColumns({"__v": v, "__w": w}).groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__w")).alias("ww"), F.sum(F.col("__w") * F.col(effect)).alias("wy"),
        F.sum(F.col("__w") * F.col(effect) * F.col(effect)).alias("wyy"))
    q = F.greatest(F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w"), F.lit(0.0))
    s = s.withColumn("q", q).withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("w") - F.col("ww") / F.col("w")), F.lit(0.0))))
    s = s.select(*by, "k", (F.col("wy") / F.col("w")).alias("fixed_effect"), "q", "tau2",
                 F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q")) * 100).otherwise(0.0).alias("i2"))
    rw = 1 / (F.col("__v") + F.col("tau2"))
    r = attach(df.withColumn("__v", v), s, by).groupBy(*by, "k", "fixed_effect", "q", "tau2", "i2").agg(
        (F.sum(rw * F.col(effect)) / F.sum(rw)).alias("random_effect"), F.sqrt(1 / F.sum(rw)).alias("random_se"))
    wide = F.sqrt(F.col("tau2") + F.col("random_se") * F.col("random_se"))
    return r.withColumns({
        "ci_low": F.col("random_effect") - NORMAL_975 * F.col("random_se"), "ci_high": F.col("random_effect") + NORMAL_975 * F.col("random_se"),
        "prediction_low": F.col("random_effect") - NORMAL_975 * wide, "prediction_high": F.col("random_effect") + NORMAL_975 * wide})


def with_heterogeneity_p(meta: DataFrame) -> DataFrame:
    return meta.withColumns({"p_value": normal_two_sided(F.col("random_effect") / F.col("random_se")),
                             "heterogeneity_p": chi_square_upper("q", (F.col("k") - 1).cast("double"))})


def reliability_bounds(df: DataFrame, cluster: str, value: str, minimum: float, count: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Identified interval of an attenuation-corrected median, with bootstrap limits."""
    low = lambda v: F.when(v >= 0, v).otherwise(F.greatest(F.lit(-1.0), v / minimum))
    high = lambda v: F.when(v >= 0, F.least(F.lit(1.0), v / minimum)).otherwise(v)
    est = exact_quantiles(df, by, value, {"observed": 0.5})
    draws = cluster_bootstrap(df, cluster, value, "median", count, seed, by)
    ci = draws.select(*by, "value", low(F.col("value")).alias("lo"), high(F.col("value")).alias("hi")).groupBy(*by).agg(
        F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"),
        F.percentile("lo", 0.025).alias("lower_ci_low"), F.percentile("hi", 0.975).alias("upper_ci_high"))
    o = F.col("observed")
    return attach(est, ci, by).select(*by, "observed", low(o).alias("corrected_lower"), high(o).alias("corrected_upper"), "ci_low", "ci_high", "lower_ci_low", "upper_ci_high")


def paired_state_test(wide: DataFrame, unit: str, pairs: Sequence[tuple[str, str]], count: int, seed: int) -> DataFrame:
    """Mean and median paired difference per state pair with bootstrap interval and sign-flip p."""
    diffs = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs]))
    long = wide.select(unit, diffs.alias("x")).select(unit, "x.*").filter(F.col("d").isNotNull())
    est = long.groupBy("contrast").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_difference"))
    est = est.join(exact_quantiles(long, ["contrast"], "d", {"median_difference": 0.5}), "contrast")
    ci = interval(cluster_bootstrap(long, unit, "d", "mean", count, seed, ["contrast"]), ["contrast"])
    null = sign_flip_null(long, unit, "d", count, seed, "mean", ["contrast"])
    p = permutation_p(null, est.select("contrast", F.col("mean_difference").alias("observed")), ["contrast"], "absolute")
    return est.join(ci, "contrast").join(p.select("contrast", "p_value"), "contrast")


def group_difference(df: DataFrame, group: str, positive, negative, value: str, cluster: str, count: int, seed: int) -> DataFrame:
    """Mean difference between two groups with a cluster bootstrap and decision."""
    pos, neg = F.col(group) == positive, F.col(group) == negative
    m = {"ps": F.when(pos, F.col(value)), "pn": F.when(pos, 1), "ns": F.when(neg, F.col(value)), "nn": F.when(neg, 1)}
    m = {k: F.coalesce(v, F.lit(0)) for k, v in m.items()}
    rows = df.filter((pos | neg) & F.col(value).isNotNull())
    gap = F.try_divide(F.col("ps"), F.col("pn").cast("double")) - F.try_divide(F.col("ns"), F.col("nn").cast("double"))
    est = rows.agg(*[F.sum(c).alias(k) for k, c in m.items()]).select(F.col("pn").alias("positive_n"), F.col("nn").alias("negative_n"), gap.alias("difference"))
    draws = bootstrap_sums(rows, [], cluster, m, count, seed).select("replicate", gap.alias("value"))
    ci = interval(draws)
    label = F.when(F.col("ci_low").isNull(), "unavailable").when(F.col("ci_low") > 0, "higher").when(F.col("ci_high") < 0, "lower").otherwise("unresolved")
    return attach_scalar(est, ci).withColumn("decision", label)


def centroid_covariance(df: DataFrame, by: Sequence[str], unit: str, axes: Sequence[str], count: int, seed: int) -> DataFrame:
    """Bootstrap centroids: per-axis interval and covariance of the draws."""
    rows = df.dropna(subset=list(axes))
    sums = bootstrap_sums(rows, by, unit, {"__n": F.lit(1), **{a: F.col(a) for a in axes}}, count, seed)
    draws = sums.select(*by, *[(F.col(a) / F.col("__n")).alias(a) for a in axes])
    out = draws.groupBy(*by).agg(
        *[F.percentile(a, 0.025).alias(f"{a}_low") for a in axes], *[F.percentile(a, 0.975).alias(f"{a}_high") for a in axes],
        *[F.covar_samp(axes[i], axes[j]).alias(f"cov_{axes[i]}_{axes[j]}") for i in range(len(axes)) for j in range(i, len(axes))])
    centre = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), *[F.avg(a).alias(f"{a}_centroid") for a in axes])
    return attach(centre, out, by)


def displacement(changes: DataFrame, unit: str, stratum: str, origin: str, destination: str, scale: float | Column, count: int, seed: int,
                 by: Sequence[str] = ()) -> DataFrame:
    """Median standardised change and its null when destinations permute inside strata."""
    d = changes.select(*by, unit, stratum, origin, destination).dropna()
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    obs = exact_quantiles(d.withColumn("__c", (F.col(destination) - F.col(origin)) / s), by, "__c", {"observed": 0.5})
    moved = permuted_values(d.select(*by, stratum, unit, destination), [*by, stratum], [unit], [destination], count, seed)
    moved = moved.join(d.select(*by, stratum, unit, origin), [*by, stratum, unit])
    null = exact_quantiles(moved.withColumn("__c", (F.col(destination) - F.col(origin)) / s), [*by, "replicate"], "__c", {"value": 0.5})
    return permutation_p(null, obs, by, "two_min")


def measurement_error_sensitivity(df: DataFrame, unit: str, value: str, multipliers: Sequence[float]) -> DataFrame:
    """Shrinkage re-estimated over within-variance multipliers: median weight, rank correlation."""
    from statewise.operators.groups import shrink_targets

    base = shrink_targets(df, unit, value, 1.0)
    w = F.col("weight")
    # weight = t/(t + s/n) gives s/(n t) = 1/w - 1, so each multiplier is a rescaling
    grid = base.select(unit, "unshrunken", w.alias("w1"), F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier"))
    grid = grid.withColumn("weight", F.when(F.col("w1") > 0, 1 / (1 + F.col("multiplier") * (1 / F.col("w1") - 1))).otherwise(0.0))
    grid = grid.withColumn("shrunken", F.col("weight") * F.col("unshrunken"))
    rho = correlation(grid, ["multiplier"], "unshrunken", "shrunken", "spearman", False).select("multiplier", "n", F.col("r").alias("spearman"))
    return exact_quantiles(grid, ["multiplier"], "weight", {"median_weight": 0.5}).join(rho, "multiplier")


def covariate_noise_sensitivity(df: DataFrame, key: str, y: str, x: str, scales: Sequence[float], count: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Slope of y on x after adding hash-normal noise of given relative sd to x."""
    from statewise.functions.hashing import normal

    sd = df.groupBy(*by).agg(F.stddev_samp(x).alias("__sd"))
    grid = attach(df.select(*by, key, y, x), sd, by).select("*", F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("scale")).select("*", F.explode(replicates(count)).alias("replicate"))
    noisy = F.col(x) + F.col("scale") * F.col("__sd") * normal(seed, F.col("replicate"), F.col(key))
    per = grid.select(*by, "scale", "replicate", y, noisy.alias("__x")).groupBy(*by, "scale", "replicate").agg(F.regr_slope(y, "__x").alias("slope"))
    return per.groupBy(*by, "scale").agg(F.avg("slope").alias("mean_slope"), F.min("slope").alias("min_slope"), F.max("slope").alias("max_slope"))
