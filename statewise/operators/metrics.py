"""Prediction, ranking, calibration and selective-risk metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewise.functions.hashing import draw, replicates
from statewise.functions.ordering import attach, exact_quantiles, prefix_sums, rank_average, rank_first, reread
from statewise.operators.ranks import bin_of_rank
from statewise.operators.resample import bh_adjust, bootstrap_sums, interval


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1)


def regression_metrics(df: DataFrame, by: Sequence[str], y: str, pred: str, spearman: bool = True) -> DataFrame:
    """R2, MAE, RMSE, Pearson, Spearman and calibration line of y on the prediction."""
    both = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.col(y) - F.col(pred)
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(y, pred).alias("pearson"), F.regr_slope(y, pred).alias("slope"), F.regr_intercept(y, pred).alias("intercept"))
    if not spearman:
        return out
    r = rank_average(rank_average(both.select(*by, y, pred), by, y, "__a"), by, pred, "__b")
    return attach(out, r.groupBy(*by).agg(F.corr("__a", "__b").alias("spearman")), by)


def auroc(df: DataFrame, by: Sequence[str], y: str, score: str, weight: str | None = None, out: str = "auroc") -> DataFrame:
    """Rank-sum AUROC; NULL when a class is absent.

    Rows merge to one per score first, so ties and repeats cost nothing.
    """
    w = _w(weight)
    t = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg"))
    c = prefix_sums(t, by, score, ["neg"])
    u = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    both = F.sum("pos") * F.sum("neg")
    return c.groupBy(*by).agg(F.when(both > 0, u / both).alias(out))


def average_precision(df: DataFrame, by: Sequence[str], y: str, score: str, weight: str | None = None, out: str = "average_precision") -> DataFrame:
    """Step-wise average precision over tied thresholds, best score first; null without positives."""
    w = _w(weight)
    t = df.filter(F.col(score).isNotNull()).groupBy(*by, (-F.col(score)).alias("__s")).agg(F.sum(w * F.col(y)).alias("pos"), F.sum(w).alias("all"))
    c = prefix_sums(t, by, "__s", ["pos", "all"])
    step = F.col("pos") * (F.col("before_pos") + F.col("pos")) / (F.col("before_all") + F.col("all"))
    return c.groupBy(*by).agg(F.when(F.sum("pos") > 0, F.sum(step) / F.sum("pos")).alias(out))


def early_precision_ratio(df: DataFrame, by: Sequence[str], y: str, score: str, key: Sequence[str], out: str = "early_precision_ratio") -> DataFrame:
    """Precision among the top P rows over prevalence (P = positives); null without positives."""
    rows = df.withColumn("__s", -F.col(score))
    ranked = rank_first(rows, by, "__s", key, "__r", "__n")
    p = df.groupBy(*by).agg(F.sum(y).alias("__p"))
    hits = F.sum(F.when(F.col("__r") <= F.col("__p"), F.col(y)).otherwise(0))
    agg = attach(ranked, p, by).groupBy(*by).agg(hits.alias("h"), F.max("__p").alias("p"), F.count(F.lit(1)).alias("n"))
    return agg.select(*by, F.when(F.col("p") > 0, F.col("h") * F.col("n") / (F.col("p") * F.col("p"))).alias(out))


def target_metrics(df: DataFrame, by: Sequence[str], y: str, score: str, key: Sequence[str]) -> DataFrame:
    """AUROC, AP and early precision per group that has both classes."""
    a = auroc(df, by, y, score)
    b = average_precision(df, by, y, score, None, "auprc")
    c = early_precision_ratio(df, by, y, score, key)
    return a.join(b, list(by)).join(c, list(by)).filter(F.col("auroc").isNotNull())


def macro_metrics(df: DataFrame, by: Sequence[str], target: str, y: str, score: str, key: Sequence[str], count: int, seed: int) -> DataFrame:
    """Mean of per-target metrics with a bootstrap over targets."""
    names = ["auroc", "auprc", "early_precision_ratio"]
    per = target_metrics(df, [*by, target], y, score, key)
    long = per.unpivot([*by, target], names, "metric", "v")
    est = long.groupBy(*by, "metric").agg(F.avg("v").alias("estimate"), F.count("v").alias("targets"))
    sums = bootstrap_sums(long, [*by, "metric"], target, {"s": F.col("v"), "c": F.lit(1)}, count, seed)
    ci = interval(sums.withColumn("value", F.col("s") / F.col("c")), [*by, "metric"])
    return est.join(ci, [*by, "metric"])


def paired_contrasts(
    df: DataFrame, by: Sequence[str], target: str, y: str, a: str, b: str, key: Sequence[str], minimum_targets: int = 100, alpha: float = 0.05,
    count: int = 2000, seed: int = 20260912,
) -> DataFrame:
    """Two scores of the same rows compared target by target, one row per (by, metric).

    Mean of each score's metric and of the paired difference, interval, error and
    centred two-sided p from a bootstrap over targets, BH over all rows, and the
    result: the score that wins beyond ``alpha`` with an interval on its side,
    unresolved, or underpowered below ``minimum_targets``.
    """
    names = ["auroc", "auprc", "early_precision_ratio"]
    cell = [*by, "metric"]
    df = reread(df.select(*by, target, y, a, b, *key))
    one = target_metrics(df, [*by, target], y, a, key).unpivot([*by, target], names, "metric", "value_a")
    two = target_metrics(df, [*by, target], y, b, key).unpivot([*by, target], names, "metric", "value_b")
    each = reread(one.join(two, [*by, target, "metric"]).withColumn("v", F.col("value_a") - F.col("value_b")))
    means = each.groupBy(*cell).agg(F.count("v").alias("targets"), F.avg("value_a").alias("mean_a"), F.avg("value_b").alias("mean_b"), F.avg("v").alias("difference"))
    draws = bootstrap_sums(each, cell, target, {"s": F.col("v"), "c": F.lit(1)}, count, seed).withColumn("value", F.col("s") / F.col("c"))
    beyond = F.sum((F.abs(F.col("value") - F.col("difference")) >= F.abs("difference")).cast("bigint"))
    null = draws.join(means.select(*cell, "difference"), cell).groupBy(*cell).agg(F.stddev_samp("value").alias("standard_error"), ((beyond + 1) / F.lit(count + 1.0)).alias("p_value"))
    out = bh_adjust(means.join(interval(draws, cell), cell).join(null, cell), "p_value", [], None, "q_value")
    sure = F.col("q_value") < alpha
    result = F.when(F.col("targets") < minimum_targets, "underpowered").when(sure & (F.col("ci_low") > 0), "a_superior").when(sure & (F.col("ci_high") < 0), "b_superior")
    return out.withColumn("result", result.otherwise("unresolved"))


def loss_improvement(df: DataFrame, by: Sequence[str], y: str, a: str, b: str, clip: float = 1e-12) -> DataFrame:
    """Brier and log loss of two probabilities and the improvement of b over a."""
    sq = lambda p: F.avg(F.pow(F.col(y) - F.col(p), F.lit(2)))

    def ll(p: str) -> Column:
        q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
        return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))

    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), sq(a).alias("brier_a"), sq(b).alias("brier_b"), ll(a).alias("log_loss_a"), ll(b).alias("log_loss_b"))
    return out.withColumns({"brier_improvement": F.col("brier_a") - F.col("brier_b"), "log_loss_improvement": F.col("log_loss_a") - F.col("log_loss_b")})


def calibration_table(df: DataFrame, pred: str, y: str, cluster: str, key: Sequence[str], bins: int = 10, fixed_width: bool = False,
                      count: int = 0, seed: int = 20260912) -> DataFrame:
    """Rows, clusters, predicted, observed and gap per bin, with cluster intervals."""
    rows = df.filter(F.col(pred).isNotNull())
    if fixed_width:
        binned = rows.withColumn("bin", F.least(F.floor(F.col(pred) * bins), F.lit(bins - 1)).cast("int"))
    else:
        ranked = rank_first(rows, [], pred, key, "__r", "__n")
        binned = ranked.withColumn("bin", bin_of_rank(F.col("__r"), F.col("__n"), bins)).drop("__r", "__n")
    per = binned.groupBy("bin", cluster).agg(F.count(F.lit(1)).alias("c"), F.sum(pred).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"))
    out = per.groupBy("bin").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("clusters"), (F.sum("sp") / F.sum("c")).alias("predicted"),
                                 (F.sum("sy") / F.sum("c")).alias("observed"))
    out = out.withColumn("gap", F.col("predicted") - F.col("observed"))
    if count:
        sums = bootstrap_sums(per, ["bin"], cluster, {"c": F.col("c"), "sy": F.col("sy")}, count, seed)
        out = out.join(interval(sums.withColumn("value", F.col("sy") / F.col("c")), ["bin"]), "bin", "left")
    return out


def heldout_rank_calibration(edges: DataFrame, by: Sequence[str], target: str, y: str, score: str, key: Sequence[str], bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Probability of a score-rank bin computed *without* the evaluated target.

    Bin and (bin, target) totals are small joins; returns (per bin, overall).
    """
    ranked = rank_first(edges, by, score, key, "__r", "__n")
    cut = F.least(F.floor((F.col("__r") - 1) * bins / F.col("__n")), F.lit(bins - 1)).cast("int")
    cells = ranked.withColumn("bin", cut).groupBy(*by, "bin", target).agg(F.count(F.lit(1)).alias("tn"), F.sum(y).alias("tp"))
    totals = cells.groupBy(*by, "bin").agg(F.sum("tn").alias("bn"), F.sum("tp").alias("bp"))
    j = cells.join(totals, [*by, "bin"])
    q = F.try_divide((F.col("bp") - F.col("tp")).cast("double"), (F.col("bn") - F.col("tn")).cast("double"))
    # all rows of a (bin, target) cell share q, so squared errors follow from counts
    j = j.withColumn("q", q).withColumn("se", F.col("tp") * F.pow(1 - F.col("q"), F.lit(2)) + (F.col("tn") - F.col("tp")) * F.pow("q", F.lit(2)))
    per = j.groupBy(*by, "bin").agg(
        F.sum("tn").alias("n_edges"), F.count(F.lit(1)).alias("n_targets"), F.sum("tp").alias("gold_edges"),
        (F.sum(F.col("q") * F.col("tn")) / F.sum("tn")).alias("mean_probability"), (F.sum("tp") / F.sum("tn")).alias("observed"), F.sum("se").alias("se"))
    gap = F.abs(F.col("mean_probability") - F.col("observed"))
    overall = per.groupBy(*by).agg((F.sum("se") / F.sum("n_edges")).alias("brier"), (F.sum(gap * F.col("n_edges")) / F.sum("n_edges")).alias("ece"))
    return per.select(*by, "bin", "n_edges", "n_targets", "gold_edges", "mean_probability", "observed", gap.alias("gap"), (F.col("se") / F.col("n_edges")).alias("bin_brier")), overall


def split_conformal(calibration: DataFrame, test: DataFrame, by: Sequence[str], residual: str, levels: Sequence[float]) -> DataFrame:
    """Radius, coverage and width per level.

    The radius is the k-th smallest absolute calibration residual, with
    k = min(n, ceil((n + 1) * level)), found by its rank.
    """
    cal = calibration.select(*by, F.abs(residual).alias("r")).filter(F.col("r").isNotNull())
    ties = prefix_sums(cal.groupBy(*by, "r").agg(F.count(F.lit(1)).alias("c")), by, "r", ["c"])
    n = cal.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    n = n.withColumn("k", F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.col("level"))))
    hit = (F.col("k") > F.col("before_c")) & (F.col("k") <= F.col("before_c") + F.col("c"))
    radius = attach(ties, n, by).filter(hit).select(*by, "level", F.col("n").alias("calibration_n"), F.col("r").alias("radius"))
    scored = attach(test.select(*by, F.abs(residual).alias("a")), radius, by)
    return scored.groupBy(*by, "level", "calibration_n", "radius").agg(
        F.count(F.lit(1)).alias("test_n"), F.avg((F.col("a") <= F.col("radius")).cast("double")).alias("coverage")).withColumn("width", 2 * F.col("radius"))


def residual_interval(train: DataFrame, test: DataFrame, by: Sequence[str], residual: str, levels: Sequence[float]) -> DataFrame:
    """Training-residual quantile interval (not conformal) and its coverage."""
    probs = {}
    for i, v in enumerate(levels):
        probs |= {f"lo_{i}": (1 - v) / 2, f"hi_{i}": (1 + v) / 2}
    cuts = exact_quantiles(train, by, residual, probs)
    stacked = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.col(f"lo_{i}").alias("low"), F.col(f"hi_{i}").alias("high")) for i, v in enumerate(levels)]))
    cuts = cuts.select(*by, stacked.alias("x")).select(*by, "x.*")
    j = attach(test.select(*by, residual), cuts, by)
    inside = (F.col(residual) >= F.col("low")) & (F.col(residual) <= F.col("high"))
    return j.groupBy(*by, "level", "low", "high").agg(F.count(F.lit(1)).alias("test_n"), F.avg(inside.cast("double")).alias("coverage"))


def selector_ranks(df: DataFrame, by: Sequence[str], key: Sequence[str], selectors: Mapping[str, bool]) -> DataFrame:
    """Long form (row, selector, position, n); ``selectors`` maps score to ascending."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(s).alias("selector"), (F.col(s) if up else -F.col(s)).cast("double").alias("__s")) for s, up in selectors.items()]))
    long = df.select("*", stacked.alias("x")).select(*df.columns, "x.*")
    return rank_first(long, [*by, "selector"], "__s", key, "position", "n").drop("__s")


def risk_coverage(df: DataFrame, by: Sequence[str], key: Sequence[str], error: str, selectors: Mapping[str, bool], coverages: Sequence[float]) -> DataFrame:
    """Mean error of the retained rows per selector and coverage."""
    ranked = selector_ranks(df.select(*by, *key, error, *[s for s in selectors if s not in (*by, *key, error)]), by, key, selectors)
    rows = ranked.select(*by, "selector", "position", "n", error, F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("coverage"))
    kept = rows.filter(F.col("position") <= F.greatest(F.ceil(F.col("n") * F.col("coverage")), F.lit(1)))
    return kept.groupBy(*by, "selector", "coverage").agg(F.count(F.lit(1)).alias("selected"), F.avg(error).alias("risk"), F.stddev_samp(error).alias("risk_sd"))


def selector_comparison(df: DataFrame, by: Sequence[str], key: Sequence[str], unit: str, error: str, bad_threshold: str, chosen: str, ascending: Mapping[str, bool],
                        coverage: float, count: int, seed: int) -> DataFrame:
    """Risk of every comparator minus that of the chosen selector, with a
    weighted unit bootstrap and false-confidence rates."""
    ranked = selector_ranks(df, by, key, ascending)
    kept = ranked.filter(F.col("position") <= F.greatest(F.ceil(F.col("n") * coverage), F.lit(1)))
    bad = (F.col(error) > F.col(bad_threshold)).cast("double")
    units = kept.groupBy(*by, unit).agg(*[
        agg.alias(f"{s}__{m}") for s in ascending for m, agg in (
            ("e", F.coalesce(F.sum(F.when(F.col("selector") == s, F.col(error))), F.lit(0.0))),
            ("n", F.coalesce(F.sum(F.when(F.col("selector") == s, 1)), F.lit(0))),
            ("b", F.coalesce(F.sum(F.when(F.col("selector") == s, bad)), F.lit(0.0))))])
    everyone = df.select(*by, unit).distinct().join(units, [*by, unit], "left").fillna(0)
    others = [s for s in ascending if s != chosen]
    ratio = lambda s, m: F.try_divide(F.sum(f"{s}__{m}"), F.sum(f"{s}__n").cast("double"))
    observed = everyone.groupBy(*by).agg(F.array(*[F.struct(
        F.lit(s).alias("comparator"), ratio(chosen, "e").alias("chosen_risk"), ratio(s, "e").alias("comparator_risk"),
        ratio(chosen, "b").alias("chosen_bad_rate"), ratio(s, "b").alias("comparator_bad_rate")) for s in others]).alias("x"))
    observed = observed.select(*by, F.explode("x").alias("x")).select(*by, "x.*").withColumn("improvement", F.col("comparator_risk") - F.col("chosen_risk"))
    measures = {f"{s}__{m}": F.col(f"{s}__{m}") for s in ascending for m in ("e", "n")}
    sums = bootstrap_sums(everyone, by, unit, measures, count, seed)
    part = lambda s: F.try_divide(F.col(f"{s}__e"), F.col(f"{s}__n").cast("double"))
    draws = sums.select(*by, "replicate", F.explode(F.array(*[
        F.struct(F.lit(s).alias("comparator"), (part(s) - part(chosen)).alias("value")) for s in others])).alias("x")).select(*by, "replicate", "x.*")
    stats = draws.groupBy(*by, "comparator").agg(
        F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"),
        ((1 + F.sum((F.col("value") <= 0).cast("bigint"))) / (F.count("value") + 1)).alias("p_value"))
    return observed.join(stats, [*by, "comparator"])


def retention(df: DataFrame, key: str, original: str, rescored: str, low: float = 0.1, high: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """Share of each tail class kept after re-scoring, by new ranks and by the fixed thresholds."""
    from statewise.functions.ordering import attach

    a = exact_quantiles(df, by, original, {"olo": low, "ohi": high})
    b = exact_quantiles(df, by, rescored, {"nlo": low, "nhi": high})
    j = attach(attach(df, a, by), b, by)
    c = lambda v, lo, hi: F.when(F.col(v) <= F.col(lo), "buffered").when(F.col(v) >= F.col(hi), "amplified").otherwise("intermediate")
    j = j.select(*by, c(original, "olo", "ohi").alias("original_class"), c(rescored, "nlo", "nhi").alias("rank_class"), c(rescored, "olo", "ohi").alias("fixed_class"))
    same = lambda k: F.avg((F.col(k) == F.col("original_class")).cast("double"))
    return j.groupBy(*by, "original_class").agg(F.count(F.lit(1)).alias("n"), same("rank_class").alias("rank_retention"), same("fixed_class").alias("fixed_retention"))


def conditional_label_coverage(probs: DataFrame, unit: Sequence[str], prob: str, is_true: str, masses: Sequence[float]) -> DataFrame:
    """Coverage of the smallest label set reaching each mass, fractional at ties."""
    true = probs.filter(is_true).select(*unit, F.col(prob).alias("__t"))
    j = probs.join(true, list(unit))
    sums = j.groupBy(*unit).agg(F.sum(F.when(F.col(prob) > F.col("__t"), F.col(prob)).otherwise(0.0)).alias("greater"),
                                F.sum(F.when(F.col(prob) == F.col("__t"), F.col(prob)).otherwise(0.0)).alias("equal"))
    long = sums.select("greater", "equal", F.explode(F.array(*[F.lit(float(m)) for m in masses])).alias("mass"))
    include = F.least(F.greatest(F.try_divide(F.col("mass") - F.col("greater"), F.col("equal")), F.lit(0.0)), F.lit(1.0))
    return long.groupBy("mass").agg(F.avg(include).alias("coverage"), F.count(F.lit(1)).alias("units"))
