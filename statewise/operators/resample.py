"""Replicated resampling: bootstraps, permutations, flips, rewiring, multiplicity.

The replicate is a column, so all replicates run in one plan. Draws are hashes
of (seed, group, replicate, unit), hence independent of partitioning and stable
when a task is run again. The resampled unit is always the independent cluster.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.hashing import digest, draw, normal, replicates, sign_draw
from statewise.functions.ordering import (
    attach,
    attach_scalar,
    exact_quantiles,
    hash_rank,
    prefix_sums,
    reread,
    settled,
    suffix_min,
    unit_index,
    weighted_quantiles,
)
from statewise.functions.tails import normal_two_sided
from statewise.session import cut_lineage, discard, written


# bootstraps

def bootstrap_draws(units: DataFrame, by: Sequence[str], count: int, seed: int) -> DataFrame:
    """(by, replicate, idx): one drawn unit number per slot. ``units`` has idx and n_units."""
    slots = units.select(*by, "idx", "n_units", F.explode(replicates(count)).alias("replicate"))
    picked = draw(F.col("n_units"), seed, *[F.col(c) for c in by], F.col("replicate"), F.col("idx"))
    return slots.select(*by, "replicate", picked.alias("idx"))


def bootstrap_sums(df: DataFrame, by: Sequence[str], cluster: str, measures: Mapping[str, Column], count: int, seed: int) -> DataFrame:
    """Sums of the measures over resampled clusters, one row per replicate.

    Rows collapse to one row per cluster first; replicates never touch rows.
    """
    per = df.groupBy(*by, cluster).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    units = reread(unit_index(per, [cluster], by))
    drawn = bootstrap_draws(units, by, count, seed)
    return drawn.join(units.select(*by, "idx", *measures), [*by, "idx"]).groupBy(*by, "replicate").agg(
        *[F.sum(m).alias(m) for m in measures])


def bootstrap_rows(df: DataFrame, by: Sequence[str], cluster: str, count: int, seed: int) -> DataFrame:
    """Rows with a replicate and the number of times their cluster was drawn."""
    df = reread(df)
    units = reread(unit_index(df.select(*by, cluster).distinct(), [cluster], by))
    weights = bootstrap_draws(units, by, count, seed).groupBy(*by, "replicate", "idx").agg(F.count(F.lit(1)).alias("weight"))
    named = weights.join(units.select(*by, cluster, "idx"), [*by, "idx"]).drop("idx")
    return named.join(df, [*by, cluster])


def bootstrap_copies(df: DataFrame, by: Sequence[str], cluster: str, count: int, seed: int) -> DataFrame:
    """Rows with ``drawn``: the replicates that took their cluster, each as often as it did.

    One row carries all its copies, so they spread where they are counted.
    """
    df = reread(df)
    units = reread(unit_index(df.select(*by, cluster).distinct(), [cluster], by))
    drawn = bootstrap_draws(units, by, count, seed).repartition(*by, "idx").groupBy(*by, "idx").agg(
        F.collect_list(F.col("replicate").cast("int")).alias("drawn"))
    named = cut_lineage(drawn.join(units.select(*by, cluster, "idx"), [*by, "idx"]).drop("idx"))
    return named.join(df, [*by, cluster])


def spread_copies(copies: DataFrame) -> DataFrame:
    """A row for each copy, with its replicate."""
    kept = [c for c in copies.columns if c != "drawn"]
    return copies.select(*kept, F.explode("drawn").alias("replicate")).withColumn("replicate", F.col("replicate").cast("bigint"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, statistic: str = "median", count: int = 2000, seed: int = 20260912,
                      by: Sequence[str] = (), prob: float = 0.5) -> DataFrame:
    """Bootstrap draws of the mean, median or a quantile: (by, replicate, value)."""
    rows = df.filter(F.col(value).isNotNull())
    if statistic == "mean":
        sums = bootstrap_sums(rows, by, cluster, {"s": F.col(value), "c": F.lit(1)}, count, seed)
        return sums.select(*by, "replicate", (F.col("s") / F.col("c")).alias("value"))
    slim = rows.groupBy(*by, cluster, value).agg(F.count(F.lit(1)).alias("__c"))
    drawn = spread_copies(bootstrap_copies(slim, by, cluster, count, seed))
    return weighted_quantiles(drawn, [*by, "replicate"], value, "__c", {"value": 0.5 if statistic == "median" else prob},
                              shape=rows.select(*by, value), again=True)


def interval(draws: DataFrame, by: Sequence[str] = (), value: str = "value", level: float = 0.95) -> DataFrame:
    """Percentile interval; a group holds one row per replicate."""
    tail = (1 - level) / 2
    return draws.groupBy(*by).agg(F.percentile(value, tail).alias("ci_low"), F.percentile(value, 1 - tail).alias("ci_high"))


def ratio_bootstrap(df: DataFrame, cluster: str, total: str, size: str, count: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Draws of sum(total)/sum(size) over resampled clusters."""
    sums = bootstrap_sums(df, by, cluster, {"t": F.col(total), "n": F.col(size)}, count, seed)
    return sums.select(*by, "replicate", F.try_divide(F.col("t"), F.col("n").cast("double")).alias("value"))


def paired_metric_bootstrap(df: DataFrame, cluster: str, y: str, a: str, b: str, metric: str, count: int, seed: int) -> DataFrame:
    """Draws of metric(a) - metric(b) for r2, brier, auroc or average_precision."""
    if metric in ("r2", "brier"):
        yy, ea, eb = F.col(y).cast("double"), F.pow(F.col(y) - F.col(a), F.lit(2)), F.pow(F.col(y) - F.col(b), F.lit(2))
        s = bootstrap_sums(df, [], cluster, {"n": F.lit(1), "sy": yy, "syy": yy * yy, "ea": ea, "eb": eb}, count, seed)
        if metric == "brier":
            value = F.col("ea") / F.col("n") - F.col("eb") / F.col("n")
        else:
            value = F.try_divide(F.col("eb") - F.col("ea"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
        return s.select("replicate", value.alias("value"))
    from statewise.operators.metrics import auroc, average_precision

    rows = bootstrap_rows(df.select(cluster, y, a, b), [], cluster, count, seed)
    f = auroc if metric == "auroc" else average_precision
    left = f(rows, ["replicate"], y, a, "weight", "ma")
    right = f(rows, ["replicate"], y, b, "weight", "mb")
    return left.join(right, "replicate").select("replicate", (F.col("ma") - F.col("mb")).alias("value"))


def multiplier_bootstrap(df: DataFrame, by: Sequence[str], cluster: str, value: str, count: int, seed: int) -> DataFrame:
    """Mean of cluster means plus se times a normal draw; groups below two clusters give NULL."""
    means = df.groupBy(*by, cluster).agg(F.avg(value).alias("m"))
    stats = means.groupBy(*by).agg(F.avg("m").alias("estimate"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("se"), F.count("m").alias("clusters"))
    drawn = stats.select("*", F.explode(replicates(count)).alias("replicate"))
    z = normal(seed, *[F.col(c) for c in by], F.col("replicate"))
    ci = interval(drawn.select(*by, "estimate", "se", "clusters", (F.col("estimate") + F.col("se") * z).alias("value")), [*by, "estimate", "se", "clusters"])
    return ci.withColumn("p_value", normal_two_sided(F.try_divide(F.col("estimate"), F.col("se"))))


# permutations

def permuted_values(df: DataFrame, strata: Sequence[str], key: Sequence[str], values: Sequence[str], count: int, seed: int,
                    minimum: int = 1) -> DataFrame:
    """Every replicate's uniform reassignment of values inside the strata.

    The r-th row in hash order gives its values to the r-th row in key order.
    Strata below ``minimum`` rows stay fixed.
    """
    base = reread(unit_index(df.select(*strata, *key, *values), key, strata, "slot", "n"))
    moved = base.select(*strata, *key, *values, "n", F.explode(replicates(count)).alias("replicate"))
    hashed = F.when(F.col("n") >= minimum, digest(seed, F.col("replicate"), *[F.col(k) for k in key])).otherwise(digest(*[F.col(k) for k in key]))
    donors = hash_rank(moved.withColumn("__h", hashed), [*strata, "replicate"], "__h", key, "slot", size="n")
    takers = base.select(*strata, *key, "slot")
    return takers.join(donors.select(*strata, "replicate", "slot", *values), [*strata, "slot"]).drop("slot")


def stratified_permutation(df: DataFrame, strata: Sequence[str], key: Sequence[str], value: str, statistic, count: int, seed: int) -> DataFrame:
    """Null draws: ``statistic(permuted, by)`` on values shuffled inside strata."""
    others = [c for c in df.columns if c not in (*strata, *key, value)]
    shuffled = permuted_values(df, strata, key, [value], count, seed)
    if others:
        shuffled = shuffled.join(df.select(*strata, *key, *others), [*strata, *key])
    return statistic(shuffled, ["replicate"])


def bundle_permutation(units: DataFrame, unit: str, stratum: str, count: int, seed: int, minimum: int = 5) -> DataFrame:
    """Whole-unit reassignment: (replicate, unit, donor) with all states moving together."""
    named = units.select(stratum, unit, F.col(unit).alias("donor"))
    return permuted_values(named, [stratum], [unit], ["donor"], count, seed, minimum)


def check_bundles(mapping: DataFrame, units: DataFrame, unit: str, stratum: str) -> DataFrame:
    """Per replicate: units, distinct donors and stratum changes (must be equal, equal, 0)."""
    home = units.select(F.col(unit).alias("donor"), F.col(stratum).alias("donor_stratum"))
    return mapping.join(home, "donor").groupBy("replicate", "donor").agg(
        F.count(F.lit(1)).alias("uses"), F.max((F.col(stratum) != F.col("donor_stratum")).cast("int")).alias("moved"),
    ).groupBy("replicate").agg(F.sum("uses").alias("units"), F.count(F.lit(1)).alias("distinct_donors"), F.sum("moved").alias("stratum_changes"))


def sign_flip_null(df: DataFrame, unit: str, value: str, count: int, seed: int, statistic: str = "mean", by: Sequence[str] = (), x: str | None = None) -> DataFrame:
    """Null draws of the mean, median or through-origin slope under random unit signs.

    For the mean and the slope rows collapse to sums of their unit first.
    """
    rows, keys = df.filter(F.col(value).isNotNull()), [*by, "replicate"]
    sign = sign_draw(seed, F.col("replicate"), F.col(unit))
    if statistic == "median":
        rows = reread(rows.select(*by, unit, value))
        signed = rows.select("*", F.explode(replicates(count)).alias("replicate")).withColumn("__v", F.col(value) * sign)
        either = rows.select(*by, F.explode(F.array(F.col(value), -F.col(value))).alias("__v"))
        return exact_quantiles(signed, keys, "__v", {"value": 0.5}, shape=either, again=True)
    over, under = (F.col(x) * F.col(value), F.col(x) * F.col(x)) if statistic == "slope" else (F.col(value), F.lit(1))
    per = rows.groupBy(*by, unit).agg(F.sum(over).alias("__o"), F.sum(under).alias("__u"))
    signed = per.select("*", F.explode(replicates(count)).alias("replicate"))
    return signed.groupBy(*keys).agg((F.sum(F.col("__o") * sign) / F.sum("__u")).alias("value"))


def tail_resampling(pairs: DataFrame, unit: str, strata: DataFrame, tail: float, count: int, seed: int, pooled: str = "Pooled") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean held-out value of the units in the training tail, with both kinds of draws.

    ``pairs`` is ``heldout_pairs``; ``strata`` is (unit, heldout_state, stratum). A
    bootstrap draw takes units again and selects its tail anew, from weighted
    quantiles of all draws at once. A null draw keeps the observed selection and permutes the
    held-out values inside the strata of each state. Returns (summary, bootstrap, null);
    ``pooled`` is all selected rows together.
    """
    pairs = reread(pairs)
    state = "heldout_state"

    def means(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
        whole = sums.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(F.lit(pooled).alias(state), *keys, "s", "n")
        return sums.select(state, *keys, "s", "n").unionByName(whole).select(state, *keys, (F.col("s") / F.col("n")).alias("value"), F.col("n").alias("selected_rows"))

    cuts = F.broadcast(exact_quantiles(pairs, [state], "training", {"cut": tail}))  # a row for each state
    selected = cut_lineage(pairs.join(cuts, state).filter(F.col("training") <= F.col("cut")).select(unit, state, "heldout"))
    point = means(selected.groupBy(state).agg(F.sum("heldout").alias("s"), F.count(F.lit(1)).alias("n")), [])
    copies = cut_lineage(bootstrap_copies(pairs.withColumn("weight", F.lit(1)), [], unit, count, seed))
    drawn = spread_copies(copies)
    again = weighted_quantiles(drawn, [state, "replicate"], "training", "weight", {"cut": tail}, shape=pairs, again=True)
    tails = drawn.join(F.broadcast(again), [state, "replicate"]).filter(F.col("training") <= F.col("cut"))
    boot = means(tails.groupBy(state, "replicate").agg(F.sum(F.col("heldout") * F.col("weight")).alias("s"), F.sum("weight").alias("n")), ["replicate"])
    moved = permuted_values(pairs.select(unit, state, "heldout").join(strata, [unit, state]), [state, "stratum"], [unit], ["heldout"], count, seed + 1)
    kept = moved.join(selected.select(unit, state), [unit, state])
    null = means(kept.groupBy(state, "replicate").agg(F.sum("heldout").alias("s"), F.count(F.lit(1)).alias("n")), ["replicate"])
    boot, null = cut_lineage(boot.select(state, "replicate", "value")), cut_lineage(null.select(state, "replicate", "value"))
    ci = interval(boot, [state])
    side = null.join(point.select(state, F.col("value").alias("estimate")), state).groupBy(state).agg(
        ((1 + F.sum((F.col("value") <= F.col("estimate") + 1e-12).cast("int"))) / (F.count("value") + 1)).alias("p_lower_tail"),
        ((1 + F.sum((F.col("value") >= F.col("estimate") - 1e-12).cast("int"))) / (F.count("value") + 1)).alias("p_upper_tail"))
    summary = point.withColumnRenamed("value", "estimate").join(ci, state).join(side, state)
    return summary, boot, null


def residual_slope_nulls(df: DataFrame, y: str, x: str, nuisance: Sequence[str], cluster: str, order: str, stratum: str, count: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two nulls of a clustered slope on residuals: (null, replicate, value) and (null, estimate, p_value).

    ``sign_swap`` flips the sign of a cluster's outcome residuals: a sum of cluster
    cross-moments. ``target_permutation`` gives a cluster the predictor residuals of
    another one of its stratum, row by row in ``order``; clusters of a stratum have the
    same order values, so the denominator never changes.
    """
    from statewise.operators.regression import residuals

    r = residuals(df.select(cluster, order, stratum, y, x, *nuisance), [], nuisance, [x, y])
    r = reread(r.select(cluster, order, stratum, F.col(f"{x}_residual").alias("__x"), F.col(f"{y}_residual").alias("__y")))
    total = r.agg(F.sum(F.col("__x") * F.col("__x")).alias("__xx"), (F.sum(F.col("__x") * F.col("__y")) / F.sum(F.col("__x") * F.col("__x"))).alias("estimate"))
    per = r.groupBy(cluster).agg(F.sum(F.col("__x") * F.col("__y")).alias("__xy")).select("*", F.explode(replicates(count)).alias("replicate"))
    swaps = per.groupBy("replicate").agg(F.sum(F.col("__xy") * sign_draw(seed, F.col("replicate"), F.col(cluster))).alias("__xy"))
    mapping = bundle_permutation(r.select(stratum, cluster).distinct(), cluster, stratum, count, seed + 1, 1).select("replicate", cluster, "donor")
    theirs = r.select(F.col(cluster).alias("donor"), order, "__x")
    moved = mapping.join(r.select(cluster, order, "__y"), cluster).join(theirs, ["donor", order])
    swapped = moved.groupBy("replicate").agg(F.sum(F.col("__x") * F.col("__y")).alias("__xy"))
    null = swaps.select(F.lit("sign_swap").alias("null"), "*").unionByName(swapped.select(F.lit("target_permutation").alias("null"), "*"))
    null = cut_lineage(attach_scalar(null, total).select("null", "replicate", (F.col("__xy") / F.col("__xx")).alias("value"), "estimate"))
    p = null.groupBy("null", "estimate").agg(((1 + F.sum((F.abs("value") >= F.abs("estimate") - 1e-12).cast("int"))) / (F.count("value") + 1)).alias("p_value"))
    return null.drop("estimate"), p


def swap_null(df: DataFrame, cluster: str, y: str, a: str, b: str, count: int, seed: int, metric: str = "brier") -> DataFrame:
    """Null of metric(a) - metric(b) when predictions swap for random clusters.

    For Brier a swap only changes the sign of the cluster's loss difference.
    """
    if metric == "brier":
        loss = F.pow(F.col(y) - F.col(a), F.lit(2)) - F.pow(F.col(y) - F.col(b), F.lit(2))
        per = df.groupBy(cluster).agg(F.sum(loss).alias("d"), F.count(F.lit(1)).alias("n"))
        s = per.select("d", "n", cluster, F.explode(replicates(count)).alias("replicate"))
        return s.groupBy("replicate").agg((F.sum(F.col("d") * sign_draw(seed, F.col("replicate"), F.col(cluster))) / F.sum("n")).alias("value"))
    from statewise.operators.metrics import auroc, average_precision

    rows = df.select(cluster, y, a, b, F.explode(replicates(count)).alias("replicate"))
    swap = draw(2, seed, F.col("replicate"), F.col(cluster)) == 1
    rows = rows.select("replicate", y, F.when(swap, F.col(b)).otherwise(F.col(a)).alias("__a"), F.when(swap, F.col(a)).otherwise(F.col(b)).alias("__b"))
    f = auroc if metric == "auroc" else average_precision
    return f(rows, ["replicate"], y, "__a", None, "ma").join(f(rows, ["replicate"], y, "__b", None, "mb"), "replicate").select(
        "replicate", (F.col("ma") - F.col("mb")).alias("value"))


def degree_matched_draw(rows: DataFrame, strata: Sequence[str], key: Sequence[str], values: Sequence[str], count: int, seed: int) -> DataFrame:
    """Replace each row by a random row of its stratum, with replacement."""
    base = unit_index(rows.select(*strata, *key, *values), key, strata, "slot", "n")
    asked = base.select(*strata, *key, "n", F.explode(replicates(count)).alias("replicate"))
    asked = asked.withColumn("slot", draw(F.col("n"), seed, F.col("replicate"), *[F.col(k) for k in key])).drop("n")
    return asked.join(base.select(*strata, "slot", *values), [*strata, "slot"]).drop("slot")


def feature_row_permutation(df: DataFrame, strata: Sequence[str], unit: str, features: Sequence[str], y: str, count: int, seed: int,
                            alpha: float = 1.0) -> DataFrame:
    """Permute the whole feature block inside strata and refit a ridge per
    replicate; returns the in-sample R2 of each refit."""
    from statewise.operators.regression import ridge_r2

    moved = permuted_values(df, strata, [unit], features, count, seed)
    return ridge_r2(moved.join(df.select(unit, y), unit), ["replicate"], features, y, alpha)


def random_abstention_null(df: DataFrame, key: str, error: str, coverages: Sequence[float], count: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean error of random subsets without replacement, per coverage and replicate."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = attach(df.select(*by, key, error), sizes, by).select("*", F.explode(replicates(count)).alias("replicate"))
    rows = hash_rank(rows.withColumn("__h", digest(seed, F.col("replicate"), F.col(key))), [*by, "replicate"], "__h", [key], "pos", size="n")
    kept = rows.select(*by, "replicate", "n", "pos", error, F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("coverage"))
    kept = kept.filter(F.col("pos") < F.greatest(F.ceil(F.col("n") * F.col("coverage")), F.lit(1)))
    return kept.groupBy(*by, "coverage", "replicate").agg(F.avg(error).alias("value"), F.count(F.lit(1)).alias("selected"))


def condition_switch_null(df: DataFrame, unit: str, state: str, value: str, count: int, seed: int) -> DataFrame:
    """Median within-unit range when values are reassigned inside each state."""
    moved = permuted_values(df.select(unit, state, value), [state], [unit], [value], count, seed)
    ranges = moved.groupBy("replicate", unit).agg((F.max(value) - F.min(value)).alias("__r"))
    return exact_quantiles(ranges, ["replicate"], "__r", {"value": 0.5})


# rewiring

def rewire_edges(edges: DataFrame, source: str, target: str, count: int, rounds: int, seed: int, swaps_per_edge: float = 1.0) -> DataFrame:
    """Degree-preserving rewiring of a simple directed graph, all replicates at once.

    Each round pairs edges by hash order inside a replicate and proposes
    (a,d),(c,b). A pair is kept only when both proposals are no self edge, occur
    once in the round and are not present already; so every in- and out-degree
    and simplicity survive. Lineage is cut in each round. Only the few proposals
    that fail come back to the pairs. The tables and shuffles of a round go when the next has its pairs.

    A replicate goes on until it has ``swaps_per_edge`` accepted swaps an edge, or
    for ``rounds`` rounds. Each row carries its replicate's ``successful_swaps``
    and ``status``: ok, or incomplete_swap when the rounds ended first.
    """
    current = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), F.explode(replicates(count)).alias("replicate"))
    over: list[DataFrame] = []
    sizes = cut_lineage(edges.agg(F.count(F.lit(1)).alias("n")))
    wanted = math.ceil(swaps_per_edge * sizes.first()[0])
    accepted = edges.sparkSession.range(count).select(F.col("id").alias("replicate"), F.lit(0).cast("bigint").alias("successful_swaps"))
    for i in range(rounds):
        hashed = digest(seed, i, F.col("replicate"), F.col("a"), F.col("b"))
        placed = hash_rank(attach_scalar(current, sizes), ["replicate"], hashed, ["a", "b"], "pos", size="n", ahead={"a": "c", "b": "d"}, opens="opens")
        # both rows of a pair lie side by side; only a pair that two buckets share is put together by a shuffle
        even = F.col("pos") % 2 == 0
        whole = even & F.col("c").isNotNull()
        kept = written(placed.filter(even | F.col("opens")).select(
            "replicate", F.when(~whole, F.col("pos")).alias("pos"), "a", "b", *[F.when(whole, F.col(x)).alias(x) for x in "cd"]), "pairs")
        if over:
            discard(*over)
        side = lambda c, odd: F.max(F.when(F.col("pos") % 2 == odd, F.col(c)))
        halves = kept.filter("pos IS NOT NULL").groupBy("replicate", F.floor(F.col("pos") / 2).alias("pair")).agg(
            side("a", 0).alias("a"), side("b", 0).alias("b"), side("a", 1).alias("c"), side("b", 1).alias("d"), F.count(F.lit(1)).alias("k")).drop("pair")
        pairs = kept.filter("pos IS NULL").drop("pos").withColumn("k", F.lit(2).cast("bigint")).unionByName(halves)
        taken = written(_taken(pairs), "taken")
        over = [kept, taken]
        going = F.broadcast(accepted.filter(F.col("successful_swaps") < wanted).select("replicate", F.lit(True).alias("going")))  # a row for each replicate at most
        few = taken.limit(FEW_TAKEN + 1).count() <= FEW_TAKEN
        judged = pairs.join(going, "replicate", "left")
        for x, y, flag in (("a", "d", "first"), ("c", "b", "second")):
            found = taken.select("replicate", F.col("x").alias(x), F.col("y").alias(y), F.lit(True).alias(flag))
            judged = judged.join(F.broadcast(found) if few else found, ["replicate", x, y], "left")
        ok = F.col("going") & (F.col("k") == 2) & (F.col("a") != F.col("d")) & (F.col("c") != F.col("b")) & F.col("first").isNull() & F.col("second").isNull()
        judged = judged.withColumn("ok", F.coalesce(ok, F.lit(False)))
        gained = judged.filter("ok").groupBy("replicate").agg(F.count(F.lit(1)).alias("gained"))
        accepted = cut_lineage(accepted.join(gained, "replicate", "left").select("replicate", (F.col("successful_swaps") + F.coalesce("gained", F.lit(0))).alias("successful_swaps")))
        current = judged.select("replicate", F.explode(F.when(F.col("ok"), _edges("ad", "cb")).when(F.col("k") == 2, _edges("ab", "cd")).otherwise(_edges("ab"))).alias("x")).select("replicate", F.col("x.x").alias("a"), F.col("x.y").alias("b"))
        if accepted.filter(F.col("successful_swaps") < wanted).isEmpty():
            break
    status = F.when(F.col("successful_swaps") >= wanted, "ok").otherwise("incomplete_swap")
    done = F.broadcast(accepted.withColumn("status", status))
    last = written(current, "rewired")
    discard(*over)
    return last.join(done, "replicate").select("replicate", F.col("a").alias(source), F.col("b").alias(target), "successful_swaps", "status")


FEW_TAKEN = 200_000  # rejected proposals that are sent to the pairs; more are joined


def _edges(*ends: str) -> Column:
    return F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ends])


def _taken(pairs: DataFrame) -> DataFrame:
    """Proposed edges (replicate, x, y) that are there already or are proposed twice: few in a sparse graph."""
    now = pairs.select("replicate", F.lit(0).alias("proposed"), F.explode(F.when(F.col("k") == 2, _edges("ab", "cd")).otherwise(_edges("ab"))).alias("e"))
    then = pairs.filter("k = 2").select("replicate", F.lit(1).alias("proposed"), F.explode(_edges("ad", "cb")).alias("e"))
    every = now.unionByName(then).select("replicate", "e.x", "e.y", "proposed")
    # 63 bits of a hash and the mark travel instead of the edges; those that meet are then compared as they are
    key = F.shiftrightunsigned(F.xxhash64("replicate", "x", "y"), 1)
    sent = every.select(F.shiftleft(key, 1).bitwiseOR(F.col("proposed").cast("bigint")).alias("h")).repartition(F.shiftrightunsigned("h", 1))
    again = sent.groupBy(F.shiftrightunsigned("h", 1).alias("h")).agg(F.count(F.lit(1)).alias("times"), F.max(F.col("h").bitwiseAND(F.lit(1).cast("bigint"))).alias("proposed"))
    again = written(again.filter("times > 1 AND proposed = 1").select("h"), "met")
    if again.limit(FEW_TAKEN + 1).count() <= FEW_TAKEN:
        every = every.join(F.broadcast(again), key == again["h"], "left_semi")
    met = every.groupBy("replicate", "x", "y").agg(F.count(F.lit(1)).alias("times"), F.max("proposed").alias("proposed"))
    return met.filter("times > 1 AND proposed = 1").select("replicate", "x", "y")


def rewiring_invariants(rewired: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """Per replicate: edges, swaps and status, repeated and self edges and degree errors (must be 0)."""
    tags = rewired.groupBy("replicate").agg(
        F.count(F.lit(1)).alias("edges"), F.max("successful_swaps").alias("successful_swaps"), F.max("status").alias("status"),
        F.sum((F.col(source) == F.col(target)).cast("bigint")).alias("self_edges"))
    again = rewired.groupBy(source, target, "replicate").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy("replicate").agg(F.sum("n").alias("repeated_edges"))
    return tags.join(again, "replicate").join(_wrong_degrees(rewired, edges, source, target), "replicate")


def _wrong_degrees(rewired: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    wrong = None
    for side in (source, target):
        then = edges.groupBy(side).agg(F.count(F.lit(1)).alias("d0"))
        now = rewired.groupBy("replicate", side).agg(F.count(F.lit(1)).alias("d1"))
        bad = now.join(then, side, "left").groupBy("replicate").agg(F.sum((~F.col("d0").eqNullSafe(F.col("d1"))).cast("bigint")).alias(f"wrong_{side}"))
        wrong = bad if wrong is None else wrong.join(bad, "replicate")
    return wrong


def rewiring_report(rewired: DataFrame, edges: DataFrame, source: str, target: str, reference: DataFrame) -> DataFrame:
    """Per replicate: edges, swaps and status, edges changed, repeated and self edges and degree errors
    (must be 0), and overlap with a reference set."""
    marked = rewired.join(edges.select(source, target).withColumn("__same", F.lit(1)), [source, target], "left")
    marked = marked.join(reference.select(source, target).distinct().withColumn("__ref", F.lit(1)), [source, target], "left")
    # counted by edge first, where the joins left them
    per = marked.groupBy(source, target, "replicate").agg(F.count(F.lit(1)).alias("__n"), F.max("successful_swaps").alias("successful_swaps"), F.max("status").alias("status"),
                                                          F.max("__same").alias("__same"), F.max("__ref").alias("__ref"))
    n = F.col("__n")
    base = per.groupBy("replicate").agg(
        F.sum(n).alias("edges"), F.max("successful_swaps").alias("successful_swaps"), F.max("status").alias("status"),
        F.sum(n - 1).alias("repeated_edges"), F.sum(F.when(F.col(source) == F.col(target), n).otherwise(0)).alias("self_edges"),
        F.sum(F.when(F.col("__same").isNull(), n).otherwise(0)).alias("changed"), F.sum(F.when(F.col("__ref").isNotNull(), n).otherwise(0)).alias("reference_overlap"))
    return base.join(_wrong_degrees(rewired, edges, source, target), "replicate")


# p-values and multiplicity

def permutation_p(null: DataFrame, observed: DataFrame, by: Sequence[str] = (), tail: str = "upper", tol: float = 1e-12,
                  value: str = "value", expected: int | None = None) -> DataFrame:
    """(1 + hits) / (R + 1) against ``observed(by, observed)``.

    Tails: upper, lower, absolute, two_min (twice the smaller tail), centred
    (bootstrap draws around the estimate) and median_centred. When a scheduled
    replicate is undefined the slot is unavailable: p is NULL.
    """
    j = attach(null, observed, by)
    if tail == "median_centred":
        j = attach(j, null.groupBy(*by).agg(F.percentile(value, 0.5).alias("__mid")), by)
    v, o = F.col(value), F.col("observed")
    hit = {
        "upper": v >= o - tol, "lower": v <= o + tol, "absolute": F.abs(v) >= F.abs(o) - tol,
        "centred": F.abs(v - o) >= F.abs(o) - tol,
    }
    if tail == "median_centred":
        hit[tail] = F.abs(v - F.col("__mid")) >= F.abs(o - F.col("__mid")) - tol
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    r = F.count(value)
    share = lambda c: (1 + n(c)) / (r + 1)
    p = F.least(F.lit(1.0), 2 * F.least(share(hit["upper"]), share(hit["lower"]))) if tail == "two_min" else share(hit[tail])
    scheduled = F.lit(expected) if expected is not None else F.count(F.lit(1))
    return j.groupBy(*by).agg(F.first("observed").alias("observed"), r.alias("finite_replicates"),
                              F.when((r == scheduled) & F.first("observed").isNotNull(), p).alias("p_value"))


def bh_adjust(df: DataFrame, p: str, family: Sequence[str] = (), m: int | None = None, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg inside each family; NULL p is skipped and not counted.

    ``m`` fixes the family size. Equal p-values merge first, and the running
    minimum from the tail is taken over ordered buckets.
    """
    size = F.lit(m) if m is not None else None
    df, small = settled(df)
    if small:
        w = Window.partitionBy(*family)
        raw = F.col(p) * (size if size is not None else F.count(p).over(w)) / F.count(p).over(w.orderBy(F.col(p).asc_nulls_last()))
        work = df.withColumn("__q", F.when(F.col(p).isNotNull(), raw))
        low = F.min("__q").over(w.orderBy(F.col(p).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        return work.withColumn(out, F.when(F.col(p).isNotNull(), F.least(low, F.lit(1.0)))).drop("__q")
    ties = df.filter(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("ties"))
    cum = prefix_sums(ties, family, p, ["ties"])
    if size is None:
        cum = attach(cum, ties.groupBy(*family).agg(F.sum("ties").alias("__m")), family)
        size = F.col("__m")
    raw = cum.select(*family, p, (F.col(p) * size / (F.col("before_ties") + F.col("ties"))).alias("__raw"))
    low = suffix_min(raw, family, p, "__raw", "__low").select(*family, p, F.least("__low", F.lit(1.0)).alias(out))
    return df.join(low, [*family, p], "left").select(*df.columns, out)


# leave-one-out

def leave_one_out(df: DataFrame, unit: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean without each unit and its change, from totals minus unit sums."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, unit).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    total = per.groupBy(*by).agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    j = attach(per, total, by)
    without = F.try_divide(F.col("ts") - F.col("s"), (F.col("tc") - F.col("c")).cast("double"))
    return j.select(*by, unit, without.alias("estimate_without"), (without - F.col("ts") / F.col("tc")).alias("change"))


def leave_one_group_out(df: DataFrame, null: DataFrame, group: str, hit: str, count_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Drop each group (e.g. chromosome) from an observed fraction *and* from
    its null draws, with frozen mappings.

    ``df`` (by, group, hit, count) and ``null`` (by, replicate, group, hit,
    count) hold sums per group, so dropping a group is a subtraction.
    """
    def without(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
        per = sums.groupBy(*keys, group).agg(F.sum(hit).alias("h"), F.sum(count_col).alias("c"))
        total = per.groupBy(*keys).agg(F.sum("h").alias("th"), F.sum("c").alias("tc"))
        return attach(per, total, keys).select(*keys, group, F.try_divide((F.col("th") - F.col("h")).cast("double"), (F.col("tc") - F.col("c")).cast("double")).alias("value"),
                                               (F.col("th") / F.col("tc")).alias("full"), (F.col("tc") - F.col("c")).alias("denominator"))

    observed = without(df, by)
    p = permutation_p(without(null, [*by, "replicate"]), observed.select(*by, group, F.col("value").alias("observed")), [*by, group])
    return observed.join(p, [*by, group]).select(*by, group, F.col("value").alias("estimate"), "full", (F.col("value") - F.col("full")).alias("difference"),
                                                 "denominator", "finite_replicates", "p_value")


def draw_summary(draws: DataFrame, by: Sequence[str], expected: int, value: str = "value") -> DataFrame:
    """Interval, median and mean of the draws with finite-replicate accounting."""
    s = draws.groupBy(*by).agg(
        F.count(value).alias("finite_replicates"), F.avg(value).alias("null_mean"), F.percentile(value, 0.5).alias("null_median"),
        F.percentile(value, 0.025).alias("ci_low"), F.percentile(value, 0.975).alias("ci_high"))
    return s.withColumn("status", F.when(F.col("finite_replicates") == expected, "complete").otherwise("unavailable"))
