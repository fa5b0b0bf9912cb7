"""Grouped summaries, composition tables and pooling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.ordering import attach, attach_scalar, exact_quantiles, spread_over
from statewise.functions.scalars import hash_fold, pair_key
from statewise.functions.tails import student_two_sided

TINY = 2.2250738585072014e-308  # the smallest normal double


def group_summary(df: DataFrame, by: Sequence[str], value: str, unit: str | None = None, quantiles: Mapping[str, float] = {}) -> DataFrame:
    """size, distinct units, mean, sd (ddof 1), min, max, median and quantiles.

    Quantiles are exact and do not gather a group in one task.
    """
    v = F.col(value).cast("double")
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"))
    if unit is not None:
        pairs = df.select(*by, unit).filter(F.col(unit).isNotNull()).distinct()
        base = attach(base, pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units")), by, "left" if by else "inner")
    return attach(base, exact_quantiles(df, by, value, {"median": 0.5, **quantiles}), by, "left" if by else "inner")


def normalised_entropy(df: DataFrame, by: Sequence[str], label: str, states: int = 3, out: str = "entropy") -> DataFrame:
    """Entropy of labels over ln(states); NULL unless the group has exactly
    ``states`` rows (rows without a label count as rows only)."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("c"))
    known = F.when(F.col(label).isNotNull(), F.col("c"))
    # -sum p ln p = ln(n) - sum(c ln c)/n, so no second pass over the shares
    agg = counts.groupBy(*by).agg(
        F.sum("c").alias("rows"), F.sum(known).alias("n"), F.sum(known * F.log(known)).alias("clc"))
    h = (F.log("n") - F.col("clc") / F.col("n")) / F.log(F.lit(float(states)))
    return agg.select(*by, F.when(F.col("rows") == states, F.greatest(h, F.lit(0.0))).alias(out))


def context_summary(df: DataFrame, unit: str, value: str, klass: str, cluster: str, states: int = 3) -> DataFrame:
    """Range, spread, class counts, cluster counts, entropy and switch per unit."""
    n = lambda c: F.sum(c.cast("bigint"))
    base = df.groupBy(unit).agg(
        (F.max(value) - F.min(value)).alias("value_range"), F.stddev_samp(value).alias("value_sd"), F.min(value).alias("value_min"),
        F.max(value).alias("value_max"), n(F.col(klass) == "amplified").alias("amplified"), n(F.col(klass) == "buffered").alias("buffered"),
        F.count(cluster).alias("cluster_rows"), F.size(F.collect_set(cluster)).cast("bigint").alias("distinct_clusters"))
    entropy = normalised_entropy(df, [unit], cluster, states, "cluster_entropy")
    return base.join(entropy, unit).withColumn(
        "cluster_switch", F.when(F.col("cluster_rows") == states, F.col("distinct_clusters") > 1))


def complete_cohort(df: DataFrame, key: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """Rows of units observed in every state."""
    seen = df.filter(F.col(state).isin(*states)).groupBy(*key).agg(
        *[F.max((F.col(state) == s).cast("int")).alias(f"s{i}") for i, s in enumerate(states)])
    full = F.lit(True)
    for i in range(len(states)):
        full = full & (F.col(f"s{i}") == 1)
    return df.join(seen.filter(full).select(*key), list(key), "left_semi")


def class_fractions(df: DataFrame, by: Sequence[str], label: str, levels: Sequence[str]) -> DataFrame:
    """Row-normalised crosstab with a fixed list of levels."""
    return df.groupBy(*by).agg(*[F.avg(F.when(F.col(label).isNotNull(), (F.col(label) == v).cast("double"))).alias(f"fraction_{v}") for v in levels])


def pivot_complete(df: DataFrame, key: Sequence[str], state: str, states: Sequence[str], value: str) -> DataFrame:
    """One column per state; units with a missing state are dropped."""
    wide = df.groupBy(*key).agg(*[F.max(F.when(F.col(state) == s, F.col(value))).alias(f"{value}_{s}") for s in states])
    for s in states:
        wide = wide.filter(F.col(f"{value}_{s}").isNotNull())
    return wide


def unpivot_states(wide: DataFrame, key: Sequence[str], states: Sequence[str], value: str, state: str = "state") -> DataFrame:
    long = wide.unpivot(list(key), [f"{value}_{s}" for s in states], state, value)
    return long.withColumn(state, F.substring(F.col(state), len(value) + 2, 64))


def pattern_key(df: DataFrame, by: Sequence[str], state: str, out: str = "pattern") -> DataFrame:
    """Sorted state-availability text per unit (states are few)."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(state)), "|").alias(out))


def density_histogram(df: DataFrame, value: str, low: float, high: float, bins: int, series: str | None = None) -> DataFrame:
    """Counts and density over fixed bins after clipping; empty bins are kept."""
    width = (high - low) / bins
    clipped = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    index = F.least(F.floor((clipped - low) / width), F.lit(bins - 1)).cast("int")
    keys = [series] if series else []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("total"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, [*keys, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return out.select(*keys, "bin", (low + F.col("bin") * width).alias("bin_left"), (low + (F.col("bin") + 1) * width).alias("bin_right"),
                      F.col("c").alias("count"), (F.col("c") / (F.col("total") * width)).alias("density"))


def implicit_zero_moments(triplets: DataFrame, sizes: DataFrame, group: str, feature: str, value: str) -> DataFrame:
    """Mean and sample variance per group and feature; absent cells count as 0."""
    sums = triplets.groupBy(group, feature).agg(F.sum(value).alias("sx"), F.sum(F.col(value) * F.col(value)).alias("sxx"))
    n = F.col("n")
    var = F.when(n > 1, F.greatest((F.col("sxx") - F.col("sx") * F.col("sx") / n) / (n - 1), F.lit(0.0)))
    return sums.join(sizes.select(group, "n"), group).select(group, feature, "n", (F.col("sx") / n).alias("mean"), var.alias("variance"))


def welch_statistics(
    triplets: DataFrame, sizes: DataFrame, group: str, feature: str, value: str, control: str, min_cells: int = 30
) -> DataFrame:
    """Welch statistics of every (group, feature) against the control group.

    All features of the control or the group are tested; a side without cells
    for a feature has mean and variance 0. Without any spread the error is the
    smallest double and the freedom null, which stands for infinite.
    """
    m = implicit_zero_moments(triplets, sizes, group, feature, value)
    c = m.filter(F.col(group) == control).select(feature, F.col("mean").alias("c_mean"), F.col("variance").alias("c_var"))
    enough = sizes.filter(F.col(group) == control).agg(F.max("n").alias("c_n"))
    groups = attach_scalar(sizes.filter((F.col(group) != control) & (F.col("n") >= min_cells)).select(group, "n"), enough)
    universe = c.select(feature).union(m.select(feature)).distinct()
    # features x eligible groups is the output itself
    listed = spread_over(universe, groups)
    j = listed.join(m.select(group, feature, "mean", "variance"), [group, feature], "left").join(c, feature, "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    a, b = zero(F.col("variance")) / F.col("n"), zero(F.col("c_var")) / F.col("c_n")
    j = j.select(group, feature, "n", "c_n", (zero(F.col("mean")) - zero(F.col("c_mean"))).alias("difference"), a.alias("a"), b.alias("b"))
    se2 = F.col("a") + F.col("b")
    down = F.pow("a", F.lit(2)) / F.greatest(F.col("n") - 1, F.lit(1)) + F.pow("b", F.lit(2)) / F.greatest(F.col("c_n") - 1, F.lit(1))
    return j.select(group, feature, "n", "difference", (F.col("difference") / F.sqrt(F.greatest(se2, F.lit(TINY)))).alias("statistic"),
                    F.when(down > 0, se2 * se2 / down).alias("freedom"))


def welch_de(triplets, sizes, group, feature, value, control, min_cells=30, fdr=0.05, min_difference=0.10) -> DataFrame:
    """Differential features: Welch p, BH within group, significance by q and size."""
    from statewise.operators.resample import bh_adjust

    t = welch_statistics(triplets, sizes, group, feature, value, control, min_cells)
    # infinite freedom: no spread at all, so any difference is beyond chance
    sure = F.when(F.col("freedom").isNull() & (F.col("difference") != 0), 0.0).otherwise(1.0)
    p = F.coalesce(student_two_sided("statistic", "freedom"), sure)
    tested = bh_adjust(t.withColumn("p", p), "p", [group])
    return tested.withColumn("significant", (F.col("q") < fdr) & (F.abs("difference") >= min_difference))


def sufficient_stats(df: DataFrame, by: Sequence[str], x: Sequence[str], y: str) -> DataFrame:
    """Upper triangle of X'X and X'y per group, one row per pair of columns."""
    names = [*x, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), F.col(f"p{i}_{j}").alias("total")) for i, j in pairs])
    return sums.select(*by, "n", F.explode(rows).alias("s")).select(*by, "n", "s.*")


def partial_pool(df: DataFrame, group: str, value: str, variance: str) -> DataFrame:
    """Empirical-Bayes group means shrunk to the precision-weighted mean."""
    w = 1.0 / F.greatest(F.col(variance), F.lit(1e-8))
    per = df.groupBy(group).agg(F.avg(value).alias("m"), F.sum(w).alias("precision"), F.sum(w * F.col(value)).alias("wx"))
    overall = per.agg((F.sum("wx") / F.sum("precision")).alias("grand"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"))
    j = attach_scalar(per, overall)
    share = F.when(F.col("between") > 0, F.col("between") / (F.col("between") + 1.0 / F.col("precision"))).otherwise(0.0)
    return j.select(group, F.col("m").alias("group_mean"), share.alias("shrinkage"), (share * F.col("m") + (1 - share) * F.col("grand")).alias("pooled"))


def shrink_targets(df: DataFrame, unit: str, value: str, multiplier: float = 1.0) -> DataFrame:
    """Variance components (within, between clipped at 0) and shrunken unit means."""
    per = df.groupBy(unit).agg(F.count(value).alias("observations"), F.avg(value).alias("unshrunken"), F.var_pop(value).alias("vp"))
    parts = per.agg(
        F.try_divide(F.sum(F.col("vp") * F.col("observations")), F.sum(F.greatest(F.col("observations") - 1, F.lit(0))).cast("double")).alias("sigma2"),
        F.var_samp("unshrunken").alias("vu"), F.avg(1.0 / F.col("observations")).alias("inv"))
    parts = parts.select("sigma2", F.greatest(F.col("vu") - F.col("sigma2") * F.col("inv"), F.lit(0.0)).alias("tau2"))
    j = attach_scalar(per.drop("vp"), parts)
    weight = F.when(F.col("tau2") == 0, 0.0).otherwise(F.col("tau2") / (F.col("tau2") + multiplier * F.col("sigma2") / F.col("observations")))
    return j.select(unit, "observations", "unshrunken", weight.alias("weight"), (F.col("unshrunken") * weight).alias("shrunken"))


def stable_variable_units(df: DataFrame, unit: str, measure: str, ranked: str, limit: float, k: int) -> DataFrame:
    """Units with a coefficient of variation below ``limit``, ranked by range."""
    per = df.groupBy(unit).agg((F.stddev_samp(measure) / F.avg(measure)).alias("variation"), (F.max(ranked) - F.min(ranked)).alias("spread"))
    return per.filter(F.col("variation") < limit).orderBy(F.desc("spread"), unit).limit(k)


def state_from_pairs(pairs: DataFrame, unit: str, value: str, evaluable: str, partners: int = 2) -> DataFrame:
    """Per unit and state: mean pair distance, only when every pair is finite."""
    sides = F.explode(F.array("left_state", "right_state"))
    long = pairs.select(unit, sides.alias("state"), F.when(F.col(evaluable), F.col(value)).alias("v"))
    return long.groupBy(unit, "state").agg(
        F.count(F.lit(1)).alias("pair_rows"), F.count("v").alias("evaluable_pairs"),
        F.when((F.count(F.lit(1)) == partners) & (F.count("v") == partners), F.avg("v")).alias("state_value"))


def control_delta(df: DataFrame, observed: str, controls: Sequence[str]) -> DataFrame:
    """Observed minus mean control; pooled control quantiles flag shared and inverted rows."""
    known = F.filter(F.array(*controls), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double"))
    pooled = df.select(F.explode(F.array(*controls)).alias("__r"))
    j = attach_scalar(df, exact_quantiles(pooled, [], "__r", {"pool_low": 0.025, "pool_high": 0.975}))
    return j.select(*df.columns, mean.alias("control_mean"), (F.col(observed) - mean).alias("delta"),
                    (F.col(observed) > F.col("pool_high")).alias("shared"), (F.col(observed) < F.col("pool_low")).alias("inverted"))


def assignment_counts(cells: DataFrame, dataset: str, cell: str, label: str) -> DataFrame:
    """Cells per distinct sorted label set (a cell carries few labels)."""
    sets = cells.groupBy(dataset, cell).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return sets.groupBy(dataset, "labels").agg(F.count(F.lit(1)).alias("cells"))


def assignment_pairs(cells: DataFrame, dataset: str, cell: str, label: str, min_pair=50, min_single=50, min_control=500) -> DataFrame:
    """Double-label pairs with single and control counts, fold and gates."""
    counts = assignment_counts(cells, dataset, cell, label)
    singles = counts.filter(F.size("labels") == 1).select(dataset, F.element_at("labels", 1).alias("t"), F.col("cells").alias("c"))
    controls = counts.filter(F.size("labels") == 0).select(dataset, F.col("cells").alias("control_cells"))
    pairs = counts.filter(F.size("labels") == 2).select(
        dataset, F.element_at("labels", 1).alias("target_a"), F.element_at("labels", 2).alias("target_b"), F.col("cells").alias("pair_cells"))
    for side in "ab":
        pairs = pairs.join(singles.select(dataset, F.col("t").alias(f"target_{side}"), F.col("c").alias(f"single_{side}_cells")),
                           [dataset, f"target_{side}"], "left")
    out = pairs.join(controls, dataset, "left").fillna(0, ["single_a_cells", "single_b_cells", "control_cells"])
    key = pair_key(F.col("target_a"), F.col("target_b"), F.col(dataset))
    reason = F.concat_ws(
        ";", F.when(F.col("pair_cells") < min_pair, "few_pair_cells"), F.when(F.col("single_a_cells") < min_single, "few_single_a_cells"),
        F.when(F.col("single_b_cells") < min_single, "few_single_b_cells"), F.when(F.col("control_cells") < min_control, "few_control_cells"))
    return out.select(dataset, "target_a", "target_b", key.alias("pair_id"), hash_fold(key, 5).alias("pair_fold"), "pair_cells", "single_a_cells",
                      "single_b_cells", "control_cells", (reason == "").alias("cell_gate_pass"), reason.alias("exclusion_reason"))
