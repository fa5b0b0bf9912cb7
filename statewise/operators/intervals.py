"""Interval joins on half-open intervals [start, end)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.ordering import prefix_sums, running_extreme

LEVELS = 4
GROWTH = 16


def _interval_bins(start: str, end: str, width: int) -> tuple[Column, Column]:
    """Level (bin width ``width * 16^level``) and the bins an interval touches.

    Long intervals use wide bins, so each touches at most 17 bins (more only
    beyond the widest level).
    """
    length = F.col(end) - F.col(start)
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(length <= width * GROWTH ** (i + 1), i).otherwise(level)
    wide = F.lit(width) * F.pow(F.lit(GROWTH), level).cast("bigint")
    return level, F.sequence(F.floor(F.col(start) / wide), F.floor((F.col(end) - 1) / wide))


def _point_bins(pos: str, width: int) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("lvl"), F.floor(F.col(pos) / (width * GROWTH**i)).alias("bin")) for i in range(LEVELS)
    ])


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, chrom: str = "chrom", pos: str = "pos", start: str = "start_pos",
    end: str = "end_pos", width: int = 1024,
) -> DataFrame:
    """All (point, interval) hits through an equi-join on (chrom, level, bin).

    A hit occurs in exactly one bin of the interval's level, so no distinct is
    needed; crowded bins are split by adaptive skew handling.
    """
    level, bins = _interval_bins(start, end, width)
    spans = intervals.filter(F.col(end) > F.col(start)).withColumn("lvl", level).withColumn("bin", F.explode(bins))
    spots = points.withColumn("__s", F.explode(_point_bins(pos, width))).select("*", "__s.*").drop("__s")
    hits = spots.join(spans, [chrom, "lvl", "bin"]).filter((F.col(start) <= F.col(pos)) & (F.col(pos) < F.col(end)))
    return hits.drop("lvl", "bin")


def covered_mass(points: DataFrame, intervals: DataFrame, point_id: str, weight: str, by: str, width: int = 1024) -> DataFrame:
    """Hits, distinct points and summed point weight inside each kind of interval."""
    hits = points_in_intervals(points, intervals, width=width)
    once = hits.groupBy(by, point_id).agg(F.first(weight).alias("w"), F.count(F.lit(1)).alias("c"))
    return once.groupBy(by).agg(F.sum("c").alias("hits"), F.count(F.lit(1)).alias("points"), F.sum("w").alias("mass"))


def interval_overlap_count(
    a: DataFrame, b: DataFrame, key: str, chrom: str = "chrom", start: str = "start_pos", end: str = "end_pos", out: str = "overlaps"
) -> DataFrame:
    """Number of ``b`` intervals overlapping each ``a`` interval, 0 kept.

    Counted as starts before the end minus ends up to the start, by prefix sums
    over positions; no overlapping pair is ever formed.
    """
    edge = lambda df, c, s, e: df.select(F.col(chrom), F.col(c).alias("x"), F.lit(s).alias("s"), F.lit(e).alias("e"))
    marks = edge(b, start, 1, 0).unionByName(edge(b, end, 0, 1)).unionByName(edge(a, start, 0, 0)).unionByName(edge(a, end, 0, 0))
    sums = prefix_sums(marks.groupBy(chrom, "x").agg(F.sum("s").alias("s"), F.sum("e").alias("e")), [chrom], "x", ["s", "e"])
    asked = a.select(key, chrom, F.explode(F.array(
        F.struct(F.col(end).alias("x"), F.lit(1).alias("side")), F.struct(F.col(start).alias("x"), F.lit(-1).alias("side")))).alias("q"))
    asked = asked.select(key, chrom, "q.x", "q.side")
    got = asked.join(sums, [chrom, "x"])
    term = F.when(F.col("side") == 1, F.col("before_s")).otherwise(-(F.col("before_e") + F.col("e")))
    counts = got.groupBy(key).agg(F.sum(term).alias(out))
    return a.join(counts, key)


def nearest_interval(
    points: DataFrame, intervals: DataFrame, chrom: str = "chrom", pos: str = "pos", start: str = "start_pos", end: str = "end_pos",
    out: str = "distance",
) -> DataFrame:
    """Fewest bases between a point and any interval: 0 inside or adjacent,
    NULL on a chromosome without intervals."""
    ends = intervals.select(chrom, F.col(start).alias("x"), F.col(end).alias("e"), F.col(start).alias("s"))
    spots = points.select(chrom, F.col(pos).alias("x"), F.lit(None).cast("bigint").alias("e"), F.lit(None).cast("bigint").alias("s"))
    marks = ends.unionByName(spots).groupBy(chrom, "x").agg(F.max("e").alias("e"), F.min("s").alias("s"))
    back = running_extreme(marks, [chrom], "x", {"e": "last_end"}, largest=True, descending=False)
    ahead = running_extreme(marks, [chrom], "x", {"s": "next_start"}, largest=False, descending=True)
    near = back.select(chrom, "x", "last_end").join(ahead.select(chrom, "x", "next_start"), [chrom, "x"])
    behind, before = F.col("x") - F.col("last_end"), F.col("next_start") - F.col("x") - 1
    distance = F.when(F.col("last_end") > F.col("x"), 0).otherwise(F.least(behind, before))
    return points.join(near.select(chrom, F.col("x").alias(pos), distance.alias(out)), [chrom, pos], "left")


def liftover(intervals: DataFrame, blocks: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Map both endpoints through aligned blocks and account for every failure.

    Blocks: chrom, block_start, block_end, to_chrom, to_start, strand, score.
    On the minus strand a block maps its first base to its last target base.
    """
    sound = F.col("end_pos") > F.col("start_pos")
    ends = intervals.filter(sound).select(key, "chrom", F.explode(F.array(
        F.struct(F.lit("first").alias("side"), F.col("start_pos").alias("pos")),
        F.struct(F.lit("last").alias("side"), (F.col("end_pos") - 1).alias("pos")))).alias("q")).select(key, "chrom", "q.*")
    spans = blocks.select("chrom", F.col("block_start").alias("start_pos"), F.col("block_end").alias("end_pos"),
                          "to_chrom", "to_start", "strand", "score")
    hits = points_in_intervals(ends, spans, width=width)
    offset = F.when(F.col("strand") == "+", F.col("pos") - F.col("start_pos")).otherwise(F.col("end_pos") - 1 - F.col("pos"))
    hits = hits.select(key, "side", F.struct("to_chrom", (F.col("to_start") + offset).alias("to_pos"), "strand").alias("place"), "score")
    scored = hits.groupBy(key, "side", "score").agg(
        F.count(F.lit(1)).alias("c"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    best = scored.groupBy(key, "side").agg(
        F.sum("c").alias("candidates"), F.max("score").alias("score"), F.max_by("lo", "score").alias("lo"), F.max_by("hi", "score").alias("hi"))
    tie = F.col("lo") != F.col("hi")
    sides = best.groupBy(key).agg(*[
        F.max(F.when(F.col("side") == s, c)).alias(f"{s}_{n}")
        for s in ("first", "last")
        for n, c in (("candidates", F.col("candidates")), ("score", F.col("score")), ("tie", tie), ("place", F.col("lo")))])
    j = intervals.join(sides, key, "left")
    first, last = F.col("first_place"), F.col("last_place")
    endpoint = lambda s: F.when(F.col(f"{s}_place").isNull(), "unmapped_endpoint").when(F.col(f"{s}_tie"), "ambiguous_best_endpoint")
    status = (
        F.when(~sound, "invalid_source_interval")
        .otherwise(F.coalesce(
            endpoint("first"), endpoint("last"),
            F.when(first["to_chrom"] != last["to_chrom"], "endpoint_chromosome_mismatch"),
            F.when(first["strand"] != last["strand"], "endpoint_orientation_mismatch"), F.lit("mapped"))))
    j = j.withColumn("status", status)
    ok = lambda c: F.when(F.col("status") == "mapped", c)
    return j.select(
        key, "status", F.coalesce("first_candidates", F.lit(0)).alias("first_candidates"),
        F.coalesce("last_candidates", F.lit(0)).alias("last_candidates"), ok(first["to_chrom"]).alias("to_chrom"),
        ok(F.least(first["to_pos"], last["to_pos"])).alias("to_start"),
        ok(F.greatest(first["to_pos"], last["to_pos"]) + 1).alias("to_end"), ok(first["strand"]).alias("to_strand"))


def gene_promoter_windows(genes: DataFrame, upstream: int = 2000, downstream: int = 500) -> DataFrame:
    """Strand-aware start site and promoter interval (genes: gene_start, gene_end, strand)."""
    plus = F.col("strand") == 1
    tss = F.when(plus, F.col("gene_start")).otherwise(F.col("gene_end")) - 1
    out = genes.withColumn("tss", tss)
    return out.withColumns({
        "start_pos": F.greatest(F.lit(0), F.col("tss") - F.when(plus, upstream).otherwise(downstream)),
        "end_pos": F.col("tss") + F.when(plus, downstream).otherwise(upstream),
        "gene_length": F.col("gene_end") - F.col("gene_start") + 1,
    })


def contact_support(contacts: DataFrame, scores: dict[str, str], threshold: float = 5.0, active: Sequence[str] = ("open", "marked"),
                    rule: str = "both") -> DataFrame:
    """Called, active and occupied contacts per gene and state.

    ``scores`` maps state to its score column; ``active`` are boolean columns
    combined by ``rule`` (both/either); occupancy comes from prey_count and
    bait_count.
    """
    flags = [F.col(c) for c in active]
    is_active = flags[0] & flags[1] if rule == "both" else flags[0] | flags[1]
    stacked = contacts.select("gene", is_active.alias("is_active"), "prey_count", "bait_count", F.explode(F.array(*[
        F.struct(F.lit(s).alias("state"), F.col(c).alias("score")) for s, c in scores.items()])).alias("x"))
    called = stacked.select("*", "x.*").filter(F.col("score") > threshold)
    n = lambda c: F.sum(c.cast("bigint"))
    return called.groupBy("gene", "state").agg(
        F.count(F.lit(1)).alias("called_links"), n(F.col("is_active")).alias("active_links"),
        n(F.col("is_active") & (F.col("prey_count") > 0)).alias("occupied_enhancer_links"),
        n(F.col("bait_count") > 0).alias("occupied_promoter_links"))
