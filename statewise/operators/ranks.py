"""Ranks, bins, strata, scaling and selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.ordering import attach, exact_quantiles, rank_average, rank_first


def rank(df: DataFrame, by: Sequence[str], value: str, key: Sequence[str], method: str = "average", out: str = "rank") -> DataFrame:
    """Rank modes first, average and pct (average rank over the non-NULL count)."""
    if method == "first":
        return rank_first(df, by, value, key, out)
    ranked = rank_average(df, by, value, out)
    if method == "average":
        return ranked
    sizes = df.groupBy(*by).agg(F.count(value).alias("__n"))
    return attach(ranked, sizes, by).withColumn(out, F.col(out) / F.col("__n")).drop("__n")


def bin_of_rank(position: Column, n: Column, k: int) -> Column:
    """Bin of the r-th of n ordered rows when cut at k equal-probability
    quantiles of the ranks (not ``ntile``)."""
    return F.when(n == 1, 0).otherwise(F.greatest(F.ceil((position - 1) * k / (n - 1)) - 1, F.lit(0))).cast("int")


def quantile_bin(df: DataFrame, value: str, k: int, key: Sequence[str], by: Sequence[str] = (), out: str = "bin") -> DataFrame:
    """Quantile bin on first-ranks, NULL values in bin -1."""
    ranked = rank_first(df, by, value, key, "__r", "__k")
    bins = F.when(F.col("__r").isNull(), -1).otherwise(bin_of_rank(F.col("__r"), F.col("__k"), k))
    return ranked.withColumn(out, bins).drop("__r", "__k")


def median_thresholds(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    out = exact_quantiles(df, by, columns[0], {f"median_{columns[0]}": 0.5})
    for c in columns[1:]:
        out = attach(out, exact_quantiles(df, by, c, {f"median_{c}": 0.5}), by)
    return out


def median_bin(df: DataFrame, unit: str, state: str, columns: Sequence[str], minimum: int = 5) -> DataFrame:
    """Unit strata from per-state low/high bins (median is low) and the states seen."""
    j = df.join(median_thresholds(df, [state], columns), state)
    labels = [F.concat_ws(":", state, F.lit(c), F.when(F.col(c) <= F.col(f"median_{c}"), "low").otherwise("high")) for c in columns]
    units = j.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(state, F.array(*labels).alias("bins")))).alias("s"))
    key = F.concat(F.lit("states="), F.concat_ws(",", F.transform("s", lambda x: x[state])), F.lit("|"),
                   F.concat_ws("|", F.flatten(F.transform("s", lambda x: x["bins"]))))
    units = units.select(unit, key.alias("stratum"))
    sizes = units.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_units"))
    return units.join(sizes, "stratum").select(unit, "stratum", "stratum_units", (F.col("stratum_units") >= minimum).alias("permutable"))


def coarsen_strata(df: DataFrame, fine: str, coarse: str, minimum: int, out: str = "stratum") -> DataFrame:
    """Merge strata below ``minimum``: fine to coarse ('x|all') to 'all'."""
    size = lambda d, c: d.groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
    first = df.join(size(df, fine), fine)
    first = first.withColumn(out, F.when(F.col("__n") < minimum, F.concat(F.col(coarse).cast("string"), F.lit("|all"))).otherwise(F.col(fine))).drop("__n")
    second = first.join(size(first, out), out)
    return second.withColumn(out, F.when(F.col("__n") < minimum, "all").otherwise(F.col(out))).drop("__n")


def best_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key in a total order; partial limits run before the shuffle."""
    return top_k_per_group(df, key, order, 1, "__r").drop("__r").select(*(columns or df.columns))


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "position") -> DataFrame:
    """First k rows per group. The rank filter is pushed below the shuffle, so
    each task sends at most k rows per group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def zscore_within(df: DataFrame, by: Sequence[str], value: str, ddof: int = 1, center: bool = False, out: str = "z") -> DataFrame:
    """Value over the group's sd, centred on request; sd 0 gives NULL."""
    sd = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    stats = df.groupBy(*by).agg(sd.alias("__s"), F.avg(value).alias("__m"))
    num = F.col(value) - F.col("__m") if center else F.col(value)
    return attach(df, stats, by).withColumn(out, F.when(F.col("__s") != 0, num / F.col("__s"))).drop("__s", "__m")


def demean_within(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    out = attach(df, means, by).withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns})
    return out.drop(*[f"__m_{c}" for c in columns])


def tail_class(df: DataFrame, value: str, low: float = 0.10, high: float = 0.90, by: Sequence[str] = (), out: str = "tail_class") -> DataFrame:
    """buffered at or below the low quantile, amplified at or above the high one,
    else (also NULL) intermediate; quantiles are taken over all rows."""
    cuts = exact_quantiles(df, by, value, {"__lo": low, "__hi": high})
    label = F.when(F.col(value) <= F.col("__lo"), "buffered").when(F.col(value) >= F.col("__hi"), "amplified").otherwise("intermediate")
    return attach(df, cuts, by).withColumn(out, label).drop("__lo", "__hi")


def heldout_pairs(df: DataFrame, unit: str, state: str, states: Sequence[str], value: str) -> DataFrame:
    """(unit, heldout_state, training, heldout): each state of a complete unit with the mean of its others."""
    from statewise.operators.groups import pivot_complete

    wide = pivot_complete(df, [unit], state, states, value)
    columns = {s: F.col(f"{value}_{s}") for s in states}
    picks = []
    for s in states:
        others = [c for o, c in columns.items() if o != s]
        total = others[0]
        for c in others[1:]:
            total = total + c
        picks.append(F.struct(F.lit(s).alias("heldout_state"), (total / len(others)).alias("training"), columns[s].alias("heldout")))
    return wide.select(unit, F.explode(F.array(*picks)).alias("x")).select(unit, "x.*")


def heldout_tail(df: DataFrame, unit: str, state: str, states: Sequence[str], value: str, tail: float = 0.10) -> DataFrame:
    """For each held-out state keep complete units whose mean over the *other*
    states is at or below the tail quantile, with the held-out value."""
    long = heldout_pairs(df, unit, state, states, value)
    cuts = exact_quantiles(long, ["heldout_state"], "training", {"cut": tail})
    return long.join(cuts, "heldout_state").filter(F.col("training") <= F.col("cut"))


def lag_pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Consecutive observations (current, following) along an ordering of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(f"{value}_next", F.lead(value).over(w)).filter(F.col(f"{value}_next").isNotNull())


def rank_by_order(df: DataFrame, key: str, classes: Sequence[str], order: Mapping[str, bool]) -> DataFrame:
    """One pick per class in turn, never reusing a unit.

    ``classes`` are boolean columns; ``order`` maps sort columns to ascending.
    Each class needs only its first ``len(classes)`` candidates, since at most
    that many can have been taken before, so the choice runs on a few rows.
    """
    sort = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order.items()] + [F.asc(key)]
    stacked = df.select(key, *order, F.explode(F.filter(F.array(*[
        F.struct(F.lit(i).alias("turn"), F.lit(c).alias("class"), F.col(c).alias("hit")) for i, c in enumerate(classes)]), lambda x: x["hit"])).alias("x"))
    stacked = stacked.select(key, *order, "x.turn", "x.class")
    short = top_k_per_group(stacked, ["turn", "class"], sort, len(classes))
    lists = short.groupBy(F.lit(1).alias("one")).agg(F.array_sort(F.collect_list(F.struct("turn", "position", "class", key))).alias("rows"))
    kind = df.schema[key].dataType.simpleString()
    empty = F.from_json(F.lit("[]"), f"array<struct<turn:int,class:string,unit:{kind}>>")

    def take(done: Column, row: Column) -> Column:
        clash = F.exists(done, lambda d: (d["turn"] == row["turn"]) | (d["unit"] == row[key]))
        one = F.array(F.struct(row["turn"].alias("turn"), row["class"].alias("class"), row[key].alias("unit")))
        return F.when(clash, done).otherwise(F.concat(done, one))

    picks = lists.select(F.explode(F.aggregate("rows", empty, take)).alias("p"))
    return picks.select((F.col("p.turn") + 1).alias("pick"), F.col("p.class").alias("class"), F.col("p.unit").alias(key))
