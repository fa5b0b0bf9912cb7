"""Sparse response vectors in long form: (unit, state, feature, value), zeros absent."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.ordering import attach, attach_scalar, reread, spread_over
from statewise.operators.ranks import top_k_per_group


def build_response(tests: DataFrame, units: DataFrame, row: Sequence[str], fdr: float = 0.10, floor: float = 0.1) -> DataFrame:
    """Significant off-target effects scaled by max(|cis|, floor).

    ``units`` has the row key, own_feature, fallback_feature and cis; a row's
    own feature (by either id) is dropped.
    """
    j = tests.join(units.select(*row, "own_feature", "fallback_feature", "cis"), list(row))
    own = F.coalesce(F.col("feature") == F.col("own_feature"), F.lit(False)) | F.coalesce(F.col("feature") == F.col("fallback_feature"), F.lit(False))
    kept = j.filter(~own & (F.col("adj_p") <= fdr) & (F.col("effect") != 0))
    return kept.select(*row, "feature", (F.col("effect") / F.greatest(F.abs("cis"), F.lit(floor))).alias("value"))


def response_metrics(tests: DataFrame, row: Sequence[str], scale: Column, fdr: float = 0.10) -> DataFrame:
    """Norms, counts, gains, effective dimension and sign balance in one pass."""
    e, se, sig = F.coalesce(F.col("effect"), F.lit(0.0)), F.coalesce(F.col("se"), F.lit(0.0)), F.coalesce(F.col("adj_p") <= fdr, F.lit(False))
    s = F.when(sig, e).otherwise(0.0)
    n = lambda c: F.sum(c.cast("bigint"))
    a = tests.groupBy(*row).agg(
        F.max(scale).alias("scale"), F.sqrt(F.sum(e * e)).alias("l2_naive"), F.sqrt(F.sum(F.greatest(e * e - se * se, F.lit(0.0)))).alias("l2_debiased"),
        F.sqrt(F.sum(s * s)).alias("l2_significant"), F.sum(F.abs(s)).alias("l1_significant"), n(sig & (e > 0)).alias("positive"), n(sig & (e < 0)).alias("negative"),
        n(sig).alias("size"), F.sum(s).alias("signed_sum"))
    ratio = lambda c: F.col(c) / F.col("scale")
    return a.select(
        *row, "l2_naive", "l2_debiased", "l2_significant", "l1_significant", "positive", "negative", "size", "signed_sum", ratio("l2_debiased").alias("gain_l2_debiased"),
        ratio("l2_significant").alias("gain_l2_significant"), ratio("l1_significant").alias("gain_l1_significant"),
        F.when(F.col("l2_significant") > 0, F.pow("l1_significant", F.lit(2)) / F.pow("l2_significant", F.lit(2))).otherwise(0.0).alias("effective_dimension"),
        ((F.col("positive") - F.col("negative")) / F.greatest(F.col("size"), F.lit(1))).alias("sign_balance"))


def state_columns(triplets: DataFrame, unit: Sequence[str], states: Sequence[str]) -> DataFrame:
    """One row per (unit, feature) with a zero-filled column per state."""
    return triplets.groupBy(*unit, "feature").agg(
        *[F.coalesce(F.sum(F.when(F.col("state") == s, F.col("value"))), F.lit(0.0)).alias(f"x{i}") for i, s in enumerate(states)])


def _state_pairs(states: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(states)) for j in range(i + 1, len(states))]


def row_cosine(triplets: DataFrame, unit: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Cosine of every state pair of a unit from one pass over (unit, feature);
    0 when a row is empty."""
    wide = state_columns(triplets, unit, states)
    k = range(len(states))
    sums = wide.groupBy(*unit).agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"d{i}_{j}") for i in k for j in k if i <= j])
    pairs = F.explode(F.array(*[F.struct(
        F.lit(states[i]).alias("left_state"), F.lit(states[j]).alias("right_state"), F.sqrt(F.col(f"d{i}_{i}")).alias("left_norm"),
        F.sqrt(F.col(f"d{j}_{j}")).alias("right_norm"), F.col(f"d{i}_{j}").alias("dot")) for i, j in _state_pairs(states)]))
    p = sums.select(*unit, pairs.alias("p")).select(*unit, "p.*")
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.col("left_norm") * F.col("right_norm")), F.lit(0.0))
    return p.select(*unit, "left_state", "right_state", "left_norm", "right_norm", cosine.alias("cosine"))


def gain_ratio(pairs: DataFrame) -> DataFrame:
    """|log2(right/left)| of norms for evaluable pairs (both positive)."""
    ok = (F.col("left_norm") > 0) & (F.col("right_norm") > 0)
    return pairs.withColumns({"evaluable": ok, "gain_ratio": F.when(ok, F.abs(F.log2(F.col("right_norm") / F.col("left_norm"))))})


def module_energy(scores: DataFrame, row: Sequence[str], module: str = "module", score: str = "score") -> DataFrame:
    """Squared share per component; an all-zero row has zero shares."""
    totals = scores.groupBy(*row).agg(F.sum(F.col(score) * F.col(score)).alias("__e"))
    share = F.when(F.col("__e") > 0, F.col(score) * F.col(score) / F.col("__e")).otherwise(0.0)
    return scores.join(totals, list(row)).select(*row, module, score, share.alias("energy"))


def dominant_module(energy: DataFrame, row: Sequence[str], module: str = "module") -> DataFrame:
    best = F.max(F.struct(F.col("energy").alias("e"), (-F.col(module)).alias("m")))
    return energy.groupBy(*row).agg(best.alias("b")).select(*row, (-F.col("b.m")).alias("dominant_module"), F.col("b.e").alias("dominant_fraction"))


def _compositions(energy: DataFrame, unit: Sequence[str], module: str, states: Sequence[str], value: str) -> DataFrame:
    return energy.groupBy(*unit, module).agg(*[F.max(F.when(F.col("state") == s, F.col(value))).alias(f"x{i}") for i, s in enumerate(states)])


def js_divergence(energy: DataFrame, unit: Sequence[str], states: Sequence[str], module: str = "module", value: str = "energy", base: float | None = 2.0) -> DataFrame:
    """Jensen-Shannon divergence of state compositions. Base 2 is clipped to
    [0, 1]; ``base=None`` keeps the natural log unclipped; a side summing to 0 gives NULL."""
    wide = _compositions(energy, unit, module, states, value)
    cells = F.explode(F.array(*[F.struct(F.lit(states[i]).alias("left_state"), F.lit(states[j]).alias("right_state"), F.col(f"x{i}").alias("l"), F.col(f"x{j}").alias("r"))
                                for i, j in _state_pairs(states)]))
    long = wide.select(*unit, cells.alias("c")).select(*unit, "c.*").filter(F.col("l").isNotNull() & F.col("r").isNotNull())
    keys = [*unit, "left_state", "right_state"]
    totals = long.groupBy(*keys).agg(F.sum("l").alias("tl"), F.sum("r").alias("tr"))
    j = long.join(totals, keys)
    p, q = F.try_divide(F.col("l"), F.col("tl")), F.try_divide(F.col("r"), F.col("tr"))
    m = (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.log(a / m)).otherwise(F.when(a.isNotNull(), 0.0))
    js = F.sum(0.5 * (part(p) + part(q)))
    out = j.groupBy(*keys).agg(F.when((F.max("tl") > 0) & (F.max("tr") > 0), js).alias("js"))
    if base is not None:
        out = out.withColumn("js", F.when(F.col("js").isNotNull(), F.least(F.greatest(F.col("js") / F.log(F.lit(float(base))), F.lit(0.0)), F.lit(1.0))))
    return out


def zero_replace(comp: DataFrame, row: Sequence[str], value: str = "energy", delta: float = 1 / 1800, tolerance: float = 1e-6) -> DataFrame:
    """Multiplicative zero replacement with closure checks as a status column."""
    s = comp.groupBy(*row).agg(F.sum(value).alias("__t"), F.sum((F.col(value) == 0).cast("int")).alias("zeros"), F.min(value).alias("__lo"))
    status = (F.when(F.col("__lo") < 0, "negative_part").when(F.col("__t") <= 0, "empty_composition").when(F.abs(F.col("__t") - 1) > tolerance, "not_closed")
              .when(F.col("zeros") * delta >= 1, "too_many_zeros").otherwise("replaced"))
    j = comp.join(s.withColumn("status", status), list(row))
    new = F.when(F.col(value) == 0, delta).otherwise(F.col(value) / F.col("__t") * (1 - F.col("zeros") * delta))
    return j.withColumn("replaced", F.when(F.col("status") == "replaced", new)).drop("__t", "__lo")


def aitchison(replaced: DataFrame, unit: Sequence[str], states: Sequence[str], module: str = "module", value: str = "replaced") -> DataFrame:
    """Distance of centred log-ratios divided by sqrt(parts).

    With d = ln l - ln r, the CLR distance squared is sum(d^2) - (sum d)^2 / parts.
    """
    wide = _compositions(replaced, unit, module, states, value)
    diff = [F.struct(F.lit(states[i]).alias("left_state"), F.lit(states[j]).alias("right_state"), (F.log(f"x{i}") - F.log(f"x{j}")).alias("d")) for i, j in _state_pairs(states)]
    long = wide.select(*unit, F.explode(F.array(*diff)).alias("c")).select(*unit, "c.*").filter(F.col("d").isNotNull())
    n, s, ss = F.count(F.lit(1)), F.sum("d"), F.sum(F.col("d") * F.col("d"))
    return long.groupBy(*unit, "left_state", "right_state").agg(F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / n).alias("aitchison"), n.alias("parts"))


def _sum(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def decompose_states(triplets: DataFrame, unit: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Core/residual energies, signed consensus and union sizes per unit."""
    k = len(states)
    wide = state_columns(triplets, unit, states)
    xs = [F.col(f"x{i}") for i in range(k)]
    core = _sum(xs) / k
    consensus = F.greatest(F.least(*xs), F.lit(0.0)) + F.least(F.greatest(*xs), F.lit(0.0))
    n = lambda c: F.sum(c.cast("bigint"))
    a = wide.groupBy(*unit).agg(
        *[F.sum(x * x).alias(f"energy_{s}") for x, s in zip(xs, states)], (k * F.sum(core * core)).alias("core_energy"),
        *[F.sum((x - core) * (x - core)).alias(f"residual_{s}") for x, s in zip(xs, states)], *[(2 * F.sum(core * (x - core))).alias(f"cross_{s}") for x, s in zip(xs, states)],
        (k * F.sum(consensus * consensus)).alias("ce"), n(consensus != 0).alias("consensus_features"), F.count(F.lit(1)).alias("union_features"))
    total = _sum([F.col(f"energy_{s}") for s in states])
    out = a.withColumns({
        "total_energy": total, "residual_energy": _sum([F.col(f"residual_{s}") for s in states]), "core_fraction": F.try_divide(F.col("core_energy"), total),
        "consensus_energy_fraction": F.try_divide(F.col("ce"), total), "consensus_feature_fraction": F.try_divide(F.col("consensus_features").cast("double"), F.col("union_features").cast("double"))})
    return out.withColumn("residual_fraction", 1 - F.col("core_fraction")).drop("ce")


def leave_one_state_prediction(triplets: DataFrame, unit: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Cosine and relative error of the mean of the other states per held-out state."""
    wide = state_columns(triplets, unit, states)
    out = []
    for i, s in enumerate(states):
        x, p = F.col(f"x{i}"), _sum([F.col(f"x{j}") for j in range(len(states)) if j != i]) / (len(states) - 1)
        out.append(F.struct(F.lit(s).alias("heldout_state"), F.sum(p * x).alias("dot"), F.sum(p * p).alias("prediction_energy"), F.sum(x * x).alias("heldout_energy"),
                            F.sum((x - p) * (x - p)).alias("error")))
    long = wide.groupBy(*unit).agg(F.array(*out).alias("a")).select(*unit, F.explode("a").alias("x")).select(*unit, "x.*")
    return long.select(*unit, "heldout_state", "prediction_energy", "heldout_energy", F.try_divide(F.col("dot"), F.sqrt(F.col("prediction_energy") * F.col("heldout_energy"))).alias("cosine"),
                       F.try_divide(F.col("error"), F.col("heldout_energy")).alias("relative_error"))


def core_permutation_null(triplets: DataFrame, strata: DataFrame, unit: str, stratum: str, states: Sequence[str], count: int, seed: int) -> DataFrame:
    """Mean core fraction when whole units are permuted inside strata in every
    state but the first (each state with its own permutation).

    Energies do not change under a permutation, so only the cross products of
    the re-paired rows are formed.
    """
    from statewise.operators.resample import bundle_permutation

    k = len(states)
    keyed = triplets.join(strata.select(unit), unit, "left_semi")
    replicate = F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")).alias("replicate")
    moved = [keyed.filter(F.col("state") == states[0]).select(replicate, unit, "feature", "value")]
    for i, s in enumerate(states[1:], start=1):
        mapping = bundle_permutation(strata, unit, stratum, count, seed + i, 1)
        rows = keyed.filter(F.col("state") == s).select(F.col(unit).alias("donor"), "feature", "value")
        moved.append(mapping.select("replicate", unit, "donor").join(rows, "donor").select("replicate", unit, "feature", "value"))
    stacked = moved[0]
    for m in moved[1:]:
        stacked = stacked.unionByName(m)
    cells = stacked.groupBy("replicate", unit, "feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("e"))
    fraction = cells.groupBy("replicate", unit).agg((F.sum(F.col("s") * F.col("s")) / k).alias("core"), F.sum("e").alias("total"))
    return fraction.groupBy("replicate").agg(F.avg(F.try_divide("core", "total")).alias("mean_core_fraction"), F.count(F.lit(1)).alias("units"))


def set_activity(triplets: DataFrame, sets: DataFrame, row: Sequence[str]) -> DataFrame:
    """Mean effect over the members of each set (absent members count as 0)."""
    sized = sets.join(sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("set_size")), "set_id")
    return triplets.join(sized, triplets["feature"] == sized["member"]).groupBy(*row, "set_id").agg((F.sum("value") / F.max("set_size")).alias("activity"))


def activity_range(activity: DataFrame, unit: str, states: int) -> DataFrame:
    """Best set per unit by its activity range over all states (missing is 0)."""
    r = activity.groupBy(unit, "set_id").agg(F.max("activity").alias("hi"), F.min("activity").alias("lo"), F.count(F.lit(1)).alias("n"))
    r = r.withColumn("range", F.when(F.col("n") < states, F.greatest(F.col("hi"), F.lit(0.0)) - F.least(F.col("lo"), F.lit(0.0))).otherwise(F.col("hi") - F.col("lo")))
    return top_k_per_group(r, [unit], [F.desc("range"), F.asc("set_id")], 1, "p").select(unit, F.col("set_id").alias("best_set"), "range")


def factor_activity(triplets: DataFrame, network: DataFrame, row: Sequence[str], n_features: int | Column, minimum: int = 5) -> DataFrame:
    """Weighted mean and univariate-model t of every (row, factor) with a
    standardised consensus.

    The regression over all features, zeros included, follows from sums over
    shared features and per-row and per-factor totals. A factor or a row that is
    the same on all features has no slope: its t is 0, not the rounding of sums.
    """
    w = network.filter("weight <> 0").groupBy("factor", "feature").agg(F.first("weight").cast("double").alias("weight"))
    factors = w.groupBy("factor").agg(F.count(F.lit(1)).alias("targets"), F.sum("weight").alias("ws"), F.sum(F.col("weight") * F.col("weight")).alias("ww")).filter(F.col("targets") >= minimum)
    rows = triplets.groupBy(*row).agg(F.sum("value").alias("xs"), F.sum(F.col("value") * F.col("value")).alias("xx"))
    raw = triplets.join(w, "feature").groupBy(*row, "factor").agg(F.sum(F.col("value") * F.col("weight")).alias("raw"))
    # every row is scored on every factor: the factor list is the output width
    full = spread_over(rows, factors).join(raw, [*row, "factor"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    n = n_features if isinstance(n_features, Column) else F.lit(float(n_features))
    cov = F.col("raw") - F.col("xs") * F.col("ws") / n
    rss, wss = F.col("xx") - F.col("xs") * F.col("xs") / n, F.col("ww") - F.col("ws") * F.col("ws") / n
    flat = (wss <= 1e-12 * F.col("ww")) | (rss <= 1e-12 * F.col("xx"))
    r = F.when(flat, F.lit(0.0)).otherwise(cov / F.sqrt(F.greatest(rss * wss, F.lit(1e-24))))
    r = F.least(F.greatest(r, F.lit(-1 + 1e-12)), F.lit(1 - 1e-12))
    scored = full.select(*row, "factor", "targets", (F.col("raw") / F.greatest(F.col("ww"), F.lit(1.0))).alias("weighted_mean"),
                         (r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-24)))).alias("ulm"))
    stats = scored.groupBy("factor").agg(*[f(c).alias(f"{p}_{c}") for c in ("weighted_mean", "ulm") for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    return scored.join(stats, "factor").select(*row, "factor", "targets", "weighted_mean", "ulm", ((z("weighted_mean") + z("ulm")) / 2).alias("consensus"))


def propagate(features: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Hops of D^-1/2 (A+I) D^-1/2 X in long form (node, column, value, hop).

    ``features``: node, column, value. ``edges``: source, target, weight, taken
    as rows of A.
    """
    nodes = features.select("node").union(edges.select(F.col("source").alias("node"))).union(edges.select(F.col("target").alias("node"))).distinct()
    loops = nodes.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(1.0).alias("weight"))
    augmented = edges.select("source", "target", F.col("weight").cast("double").alias("weight")).unionByName(loops)
    degree = augmented.groupBy("source").agg(F.greatest(F.sum("weight"), F.lit(1e-12)).alias("degree"))
    scaled = augmented.join(degree, "source").join(degree.select(F.col("source").alias("target"), F.col("degree").alias("target_degree")), "target")
    scaled = scaled.select("source", F.col("target").alias("node"), (F.col("weight") / F.sqrt(F.col("degree") * F.col("target_degree"))).alias("w"))
    current = features.select("node", "column", F.col("value").cast("double").alias("value"))
    out = current.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        current = scaled.join(current, "node").groupBy("source", "column").agg(F.sum(F.col("w") * F.col("value")).alias("value")).withColumnRenamed("source", "node")
        out = out.unionByName(current.withColumn("hop", F.lit(hop)))
    return out


def knn_graph(features: DataFrame, node: str, vector: str | Sequence[str], k: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Exact k nearest neighbours (source, target, distance, slot), blockwise."""
    from statewise.operators.matching import blocked_knn

    found = blocked_knn(features, features, by, node, node, vector, k, skip_self=True)
    return found.select(*by, F.col("query").alias("source"), F.col("candidate").alias("target"), "distance", "slot")


def knn_regression(train: DataFrame, test: DataFrame, node: str, vector: str | Sequence[str], y: str, k: int = 15) -> DataFrame:
    """Distance-weighted neighbour mean; exact hits take all the weight."""
    from statewise.operators.matching import blocked_knn

    found = blocked_knn(test, train, [], node, node, vector, k)
    j = found.join(train.select(F.col(node).alias("candidate"), F.col(y).alias("__y")), "candidate")
    hits = F.sum((F.col("distance") == 0).cast("int"))
    exact = F.avg(F.when(F.col("distance") == 0, F.col("__y")))
    weighted = F.sum(F.when(F.col("distance") > 0, F.col("__y") / F.col("distance"))) / F.sum(F.when(F.col("distance") > 0, 1 / F.col("distance")))
    return j.groupBy(F.col("query").alias(node)).agg(F.when(hits > 0, exact).otherwise(weighted).alias("prediction"), F.avg("__y").alias("neighbor_mean"))


def packed_rows(triplets: DataFrame, unit: str) -> DataFrame:
    """One row per unit with parallel feature and value arrays (one vector wide)."""
    return triplets.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("__p")).select(
        unit, F.transform("__p", lambda x: x["feature"].cast("string")).alias("f"), F.transform("__p", lambda x: x["value"]).alias("v"))


HIT = 50
SCORED = 256  # units of a group scored at a time
DENSE = 1 << 17  # entries of the matrix of classes that they meet, about
GROUPS = 48  # groups of units, over all decodings
GROUP_UNITS = 1 << 16  # in a group at most, about


def decode_states(query: DataFrame, centroids: DataFrame, unit: str, betas: Sequence[float], model: str = "cosine", scale: float = 1.0, block: int = 4096,
                  units: DataFrame | None = None, by: Sequence[str] = (), scoring: str | None = None) -> DataFrame:
    """Softmax decoding of each unit among all classes, per inverse temperature.

    ``query`` and ``centroids`` are sparse rows (by..., unit, feature, value). ``units``
    (unit) lists the units to decode, which are then the classes too; one without a
    vector is the zero vector. Without it the units of either side are taken. ``by``
    are keys of independent decodings.

    Sparse cosine scores come from an inverted index on features; pairs that share no
    feature score 0 and enter the sums as a count, so they are never made. Each hit is a
    shuffled row, though, which costs as much as ``HIT`` pairs scored inside a task; where the
    counted hits cost more than all pairs, and for distances, whose every pair differs,
    pairs are scored block by block instead. Both ways give the
    same rows; ``scoring`` ("index" or "blocks") names one.
    """
    keys = [*by, unit]
    tags = query.select(*by).distinct() if by else None
    if units is not None:
        every = units.select(unit).distinct()
        every = spread_over(every, tags) if by else every
    asked = every if units is not None else query.select(*keys).distinct()
    known = every if units is not None else centroids.select(*keys).distinct()
    classes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("classes"))
    if scoring is None and model == "cosine":
        query, centroids = reread(query, compact=True), reread(centroids, compact=True)
        asked, known = (reread(every),) * 2 if units is not None else (asked, known)
        met = lambda d, n: d.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias(n))
        hits = met(query, "a").join(met(centroids, "b"), [*by, "feature"]).agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0.0
        pairs = attach(asked.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), classes, by).agg(F.sum(F.col("n").cast("double") * F.col("classes"))).first()[0] or 0.0
        scoring = "index" if hits * HIT <= pairs else "blocks"
    if model == "cosine" and scoring == "index":
        merged = _index_scores(query, centroids, asked, known, classes, unit, betas, by)
    else:
        merged = _block_scores(query, centroids, asked, known, classes, unit, betas, model, scale, block, by)
    log_p = F.col("beta") * F.col("true_score") - F.col("log_z")
    return merged.select(*keys, "beta", "classes", "true_score", log_p.alias("log_probability"), (F.log(F.col("classes").cast("double")) + log_p).alias("information"),
                         F.when(F.col("true_score") >= F.col("best") - 1e-14, 1.0 / F.col("ties")).otherwise(0.0).alias("fractional_top1"))


def _index_scores(query: DataFrame, centroids: DataFrame, asked: DataFrame, known: DataFrame, classes: DataFrame, unit: str, betas: Sequence[float], by: Sequence[str]) -> DataFrame:
    keys = [*by, unit]
    norm = lambda d: d.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    side = lambda d, e, u, v, n: d.join(e, keys, "left_semi").join(norm(d), keys).filter("value <> 0 AND norm > 0").select(*by, F.col(unit).alias(u), "feature", F.col("value").alias(v), F.col("norm").alias(n))
    hits = side(query, asked, "_u", "_x", "_nx").join(side(centroids, known, "_c", "_y", "_ny"), [*by, "feature"])
    pairs = hits.groupBy(*by, "_u", "_c").agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"), F.first("_nx").alias("_nx"), F.first("_ny").alias("_ny"))
    whole = F.col("_nx") * F.col("_ny")
    score = F.when(whole > 1e-12, F.greatest(F.least(F.col("dot") / whole, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    s = pairs.select(*by, F.col("_u").alias(unit), "_c", score.alias("s")).withColumn("_top", F.max("s").over(Window.partitionBy(*keys)))
    parts = F.array(*[F.sum(F.exp(float(m) * (F.col("s") - F.col("_top")))) for m in betas])
    seen = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("met"), F.max("_top").alias("top"), parts.alias("parts"), F.max(F.when(F.col("_c") == F.col(unit), F.col("s"))).alias("hit"),
                                F.sum((F.col("s") >= F.col("_top") - 1e-14).cast("bigint")).alias("at_top"), F.sum((F.abs("s") <= 1e-14).cast("bigint")).alias("at_zero"))
    out = attach(asked.join(seen, keys, "left"), classes, by)
    out = out.join(known.withColumn("_known", F.lit(True)), keys, "left")
    zeros = F.col("classes") - F.coalesce("met", F.lit(0))
    out = out.withColumn("zeros", zeros).withColumn("best", F.when(F.col("met").isNull(), 0.0).when(F.col("zeros") > 0, F.greatest("top", F.lit(0.0))).otherwise(F.col("top")))
    near = lambda c: F.col(c) >= F.col("best") - 1e-14
    ties = F.when(F.col("met").isNotNull() & near("top"), F.col("at_top")).otherwise(0)
    ties = ties + F.when(F.col("best") <= 1e-14, F.col("zeros") + F.when(~near("top"), F.col("at_zero")).otherwise(0)).otherwise(0)
    out = out.select(*keys, "classes", "zeros", "top", "best", "parts", ties.alias("ties"), F.when(F.col("_known"), F.coalesce("hit", F.lit(0.0))).alias("true_score"))
    long = out.select("*", F.posexplode(F.array(*[F.lit(float(m)) for m in betas])).alias("i", "beta"))
    met = F.coalesce(F.get("parts", F.col("i")) * F.exp(F.col("beta") * (F.col("top") - F.col("best"))), F.lit(0.0))
    return long.withColumn("log_z", F.col("beta") * F.col("best") + F.log(met + F.col("zeros") * F.exp(-F.col("beta") * F.col("best"))))


class _Asked:
    """The units of a group and what their scores with the classes met so far add up to."""

    def __init__(self, run: str, betas: np.ndarray, model: str, scale: float):
        self.run, self.betas, self.model, self.scale = run, betas, model, scale
        self.parts: list[pa.RecordBatch] = []
        self.met = False

    def _begin(self) -> None:
        self.rows = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts, self.met, n = [], True, self.rows.num_rows
        self.sizes, names, self.values = _sparse(self.rows)
        self.names = pc.unique(names)
        self.codes = pc.index_in(names, value_set=self.names).to_numpy()
        self.first = np.append(0, np.cumsum(self.sizes))
        self.squares = np.bincount(np.repeat(np.arange(n), self.sizes), self.values**2, n)
        self.index = pd.Index(self.rows["unit"].to_pandas())
        self.best, self.ties, self.true = np.full(n, -np.inf), np.zeros(n, dtype=np.int64), np.full(n, np.nan)
        self.sums = np.zeros((n, len(self.betas)))  # of exp(beta * (score - best))

    def meet(self, classes: pa.RecordBatch) -> None:
        if not self.met:
            self._begin()
        most = max(SCORED, DENSE // max(1, len(self.names)))
        for at in range(0, classes.num_rows, most):
            self._score(classes.slice(at, most))

    def _score(self, classes: pa.RecordBatch) -> None:
        sizes, names, values = _sparse(classes)
        at = np.repeat(np.arange(len(sizes)), sizes)
        codes = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy()
        y = np.zeros((len(sizes), len(self.names)))
        y[at[codes >= 0], codes[codes >= 0]] = values[codes >= 0]
        yy = np.bincount(at, values**2, len(sizes))
        mine = self.index.get_indexer(classes.column("unit").to_pandas())
        own = np.flatnonzero(mine >= 0)
        own = own[np.argsort(mine[own], kind="stable")]
        for start in range(0, len(self.sizes), SCORED):
            some = slice(start, min(start + SCORED, len(self.sizes)))
            held = slice(self.first[some.start], self.first[some.stop])
            x = np.zeros((some.stop - some.start, len(self.names)))
            x[np.repeat(np.arange(len(x)), self.sizes[some]), self.codes[held]] = self.values[held]
            s, xx = x @ y.T, self.squares[some, None]
            if self.model == "cosine":
                norm = np.sqrt(xx * yy)
                s = np.clip(np.divide(s, norm, out=np.zeros_like(s), where=norm > 1e-12), -1, 1)
            else:
                s = -np.maximum(0, xx + yy - 2 * s) / self.scale
            here = own[slice(*np.searchsorted(mine[own], [some.start, some.stop]))]
            self.true[mine[here]] = s[mine[here] - some.start, here]
            top, before = s.max(1), self.best[some]
            ties = (s >= top[:, None] - 1e-14).sum(1)
            self.ties[some] = np.where(before >= top - 1e-14, self.ties[some], 0) + np.where(top >= before - 1e-14, ties, 0)
            best = np.maximum(before, top)
            s -= best[:, None]
            for k, beta in enumerate(self.betas):
                self.sums[some, k] = np.where(before > -np.inf, self.sums[some, k] * np.exp(beta * np.where(before > -np.inf, before - best, 0)), 0) + np.exp(beta * s).sum(1)
            self.best[some] = best

    def result(self, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
        if self.met and self.rows.num_rows:
            lse = self.betas * self.best[:, None] + np.log(self.sums)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lse) + 1, dtype=np.int32) * len(self.betas)), pa.array(lse.ravel()))
            out = [pa.array(self.best), pa.array(self.ties), pa.array(self.true, mask=np.isnan(self.true))]
            done = pa.table([*[self.rows[k] for k in keys], lists, *out], names=[*keys, "lse", "best", "ties", "true_score"])
            yield from done.combine_chunks().to_batches(max_chunksize=1 << 14)


def _sparse(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Entries of each row, and the features and values of all in turn."""
    f, v = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows.column("f"), rows.column("v")))
    return pc.list_value_length(f).to_numpy(), pc.list_flatten(f), pc.list_flatten(v).to_numpy()


def _block_scores(query: DataFrame, centroids: DataFrame, asked: DataFrame, known: DataFrame, classes: DataFrame, unit: str, betas: Sequence[float], model: str, scale: float, block: int, by: Sequence[str]) -> DataFrame:
    """Scores of all pairs. Units to decode are dealt into groups; the classes go to each group and stream
    past it, so a row is shuffled ``GROUPS`` times over all decodings at most, up to ``GROUP_UNITS`` units a group."""
    keys = [*by, unit]
    none = lambda d, e: e.join(d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("p")), keys, "left").select(
        *by, F.col(unit).alias("unit"), F.coalesce(F.transform("p", lambda x: x["feature"].cast("string")), F.array().cast("array<string>")).alias("f"), F.coalesce(F.transform("p", lambda x: x["value"].cast("double")), F.array().cast("array<double>")).alias("v"))
    most, decodings = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-most // GROUP_UNITS), min(-(-most // block), GROUPS // max(1, decodings)))
    left = none(query, asked).select("*", F.lit(0).alias("side"), F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("int").alias("group"))
    right = none(centroids, known).select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    run = F.to_json(F.struct(*by, "group"), {"ignoreNullFields": "false"})
    rows = left.unionByName(right).withColumn("run", run).drop("group")
    # a number of its own: what a task costs is its pairs, so few bytes are no reason to merge tasks
    rows = rows.repartition(max(int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups * decodings, GROUPS) * 2), "run").sortWithinPartitions("run", "side")
    b, names = np.asarray(betas, dtype=float), [*by, "unit"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            runs, sides = batch.column("run"), batch.column("side").to_numpy()
            change = np.diff(runs.dictionary_encode().indices.to_numpy()) != 0
            cuts = np.flatnonzero(change | (np.diff(sides) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(sides)]):
                if start == end:
                    continue
                if held is None or held.run != runs[start].as_py():
                    if held is not None:
                        yield from held.result(names)
                    held = _Asked(runs[start].as_py(), b, model, scale)
                piece = batch.slice(start, end - start)
                if sides[start] == 0:
                    held.parts.append(piece)
                elif held.parts or held.met:
                    held.meet(piece)
        if held is not None:
            yield from held.result(names)

    kind = lambda c: f"{c} {rows.schema[c].dataType.simpleString()}"
    part = rows.mapInArrow(score, ", ".join([*map(kind, names), "lse array<double>", "best double", "ties bigint", "true_score double"]))
    long = attach(part, classes, by).select("*", F.posexplode(F.array(*[F.lit(float(x)) for x in betas])).alias("i", "beta"))
    return long.withColumn("log_z", F.get("lse", F.col("i"))).withColumnRenamed("unit", unit)


def nested_decode(triplets: DataFrame, unit: str, state: str, states: Sequence[str], betas: Sequence[float], units: DataFrame, model: str = "cosine", scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Decoding of each held-out state with a temperature chosen on the other states alone.

    For each held-out state every other state is decoded from each remaining one; the
    temperature of the lowest mean inner loss (ties to the lower) decodes the held-out
    state from the mean of the others. Returns (inner losses: heldout_state,
    inner_training_state, inner_validation_state, beta, log_loss, targets; predictions:
    heldout_state and the columns of ``decode_states``).
    """
    inner = [(h, t, v) for h in states for t in states for v in states if len({h, t, v}) == 3]
    names = ["heldout_state", "inner_training_state", "inner_validation_state"]
    listed = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, task)]) for task in inner])
    spread = lambda role: triplets.select("*", F.explode(F.filter(listed, lambda t: t[role] == F.col(state))).alias("_t")).select("_t.*", unit, "feature", "value")
    tried = decode_states(spread(names[2]), spread(names[1]), unit, betas, model, scale, units=units, by=names)
    losses = reread(tried.groupBy(*names, "beta").agg(F.avg(-F.col("log_probability")).alias("log_loss"), F.count(F.lit(1)).alias("targets")))
    mean = losses.groupBy("heldout_state", "beta").agg(F.avg("log_loss").alias("loss"))
    chosen = mean.groupBy("heldout_state").agg(F.min(F.struct("loss", "beta")).alias("m")).select("heldout_state", F.col("m.beta").alias("beta"))
    held = F.explode(F.filter(F.array(*[F.lit(s) for s in states]), lambda s: s != F.col(state))).alias("heldout_state")
    centroids = triplets.select(held, unit, "feature", "value").groupBy("heldout_state", unit, "feature").agg((F.sum("value") / (len(states) - 1)).alias("value"))
    asked = triplets.select(F.col(state).alias("heldout_state"), unit, "feature", "value")
    out = decode_states(asked, centroids, unit, betas, model, scale, units=units, by=["heldout_state"])
    return losses, out.join(chosen, ["heldout_state", "beta"])


def choose_beta(scored: DataFrame) -> DataFrame:
    """The inverse temperature with the lowest mean log loss (one row)."""
    loss = scored.groupBy("beta").agg(F.avg(-F.col("log_probability")).alias("log_loss"))
    return loss.orderBy("log_loss", "beta").limit(1)


def edge_deletion_sensitivity(triplets: DataFrame, loadings: DataFrame, row: Sequence[str], k: int = 10) -> DataFrame:
    """Effect of deleting each of a row's top features on norm, module
    concentration, redistribution and cosine.

    Scores update by subtracting loading x value, so nothing is re-projected.
    """
    top = top_k_per_group(triplets, row, [F.desc(F.abs("value")), F.asc("feature")], k, "position")
    scores = triplets.join(loadings, "feature").groupBy(*row, "module").agg(F.sum(F.col("value") * F.col("loading")).alias("score"))
    norms = triplets.groupBy(*row).agg(F.sum(F.col("value") * F.col("value")).alias("norm2"))
    cells = top.join(scores, list(row)).join(loadings, ["feature", "module"], "left").withColumn("loading", F.coalesce("loading", F.lit(0.0)))
    cells = cells.withColumn("changed", F.col("score") - F.col("loading") * F.col("value"))
    keys = [*row, "feature", "position", "value"]
    total = cells.groupBy(*keys).agg(F.sum(F.col("score") * F.col("score")).alias("t0"), F.sum(F.col("changed") * F.col("changed")).alias("t1"))
    c = cells.join(total, keys)
    e0 = F.col("score") * F.col("score") / F.when(F.col("t0") > 0, F.col("t0")).otherwise(1.0)
    e1 = F.col("changed") * F.col("changed") / F.when(F.col("t1") > 0, F.col("t1")).otherwise(1.0)
    m = c.groupBy(*keys).agg((F.max(e1) - F.max(e0)).alias("concentration_change"), (0.5 * F.sum(F.abs(e1 - e0))).alias("redistribution"))
    m = m.join(norms, list(row))
    left = F.sqrt(F.greatest(1 - F.col("value") * F.col("value") / F.col("norm2"), F.lit(0.0)))
    return m.select(*row, "feature", "position", (left - 1).alias("norm_change"), "concentration_change", "redistribution", F.when(left > 0, 1 - left).alias("signature_loss"))
