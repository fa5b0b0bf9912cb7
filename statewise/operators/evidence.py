"""Signed edge evidence: curation, two-hop paths, classes, tiers and sensitivities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewise.functions.scalars import is_palindromic, orient_alleles
from statewise.operators.contracts import priority_class
from statewise.operators.ranks import top_k_per_group

# fixed labels, in priority order
EDGE_CLASSES = ("enhancer-linked", "promoter-bound", "motif-supported", "one-step", "higher-order", "unsupported")
TIERS = ("Tier 1", "Tier 2", "Tier 3", "Tier 4")
MARK_WORDS = 8  # 64-bit words of a step's marks; a full set lets all through, to the exact join


def curate_edges(raw: DataFrame, resources: Mapping[str, str]) -> DataFrame:
    """One row per (source, response): unique direction or conflict, a flag per
    resource pattern and the resource list; self edges are removed."""
    flags = {name: F.bool_or(F.col("resource").rlike(pattern)) for name, pattern in resources.items()}
    signed = F.when(F.col("direction") != 0, F.col("direction"))
    g = raw.filter(F.col("source") != F.col("response")).groupBy("source", "response").agg(
        F.min(signed).alias("lo"), F.max(signed).alias("hi"), *[f.alias(n) for n, f in flags.items()])
    conflict = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))
    names = F.concat_ws(";", *[F.when(F.col(n), F.lit(n)) for n in resources])
    return g.select("source", "response", F.when(~conflict, F.coalesce("hi", F.lit(0))).otherwise(0).alias("prior_direction"), conflict.alias("direction_conflict"),
                    *resources, names.alias("resources"))


def _unit_slot() -> Column:
    return F.pmod(F.xxhash64("source", "state"), F.lit(64 * MARK_WORDS)).cast("int")


def _unit_marks(effects: DataFrame, key: str) -> DataFrame:
    """A bit set of the hashed (source, state) of each key, of the same size for any number of them."""
    bit = F.expr("shiftleft(1L, __slot & 63)")
    marked = effects.select(key, _unit_slot().alias("__slot")).select(key, F.shiftright("__slot", 6).alias("__word"), bit.alias("__bit"))
    bits = [F.coalesce(F.bit_or(F.when(F.col("__word") == i, F.col("__bit"))), F.lit(0)) for i in range(MARK_WORDS)]
    return marked.groupBy(key).agg(F.array(*bits).alias("marks"))


def _marked(marks: str) -> Column:
    """Whether the (source, state) of the row may be in the set; false only if it is not."""
    slot = _unit_slot()
    return F.getbit(F.get(marks, F.shiftright(slot, 6)), slot.bitwiseAND(63)) == 1


def _first_hops(effects: DataFrame, prior: DataFrame) -> DataFrame:
    """Source -> intermediate -> distal; most rows whose (source, state) does not
    respond at the distal are left out, by the marks that each step carries."""
    mid = effects.select("source", "state", F.col("response").alias("intermediate"), F.col("effect").alias("mid_effect"))
    steps = prior.filter("prior_direction <> 0").select(F.col("source").alias("intermediate"), F.col("response").alias("distal"), "prior_direction")
    steps = steps.join(_unit_marks(effects.withColumnRenamed("response", "distal"), "distal"), "distal")
    # a condition on mid alone would move below the aggregation that made it, which is shared then no more; no step has direction 0
    apart = (F.col("distal") != F.col("source")) & ((F.col("intermediate") != F.col("source")) | (F.col("prior_direction") == 0))
    return mid.join(steps, "intermediate").filter(apart & _marked("marks")).drop("marks")


def two_hop_paths(effects: DataFrame, prior: DataFrame) -> DataFrame:
    """Source -> affected intermediate -> affected distal inside (source, state).

    Per distal: path counts, agreeing and conflicting paths, and the strongest
    intermediate by (|effect|, name). The first hop joins effects to prior
    edges on the intermediate and drops most that miss the distal by a hashed
    bit set; the second confirms the distal by equi-join.
    """
    end = effects.select("source", "state", F.col("response").alias("distal"), F.col("effect").alias("distal_effect"))
    paths = _first_hops(effects, prior).join(end, ["source", "state", "distal"])
    agree = F.signum("distal_effect") == F.signum("mid_effect") * F.col("prior_direction")
    best = F.max(F.struct(F.abs("mid_effect").alias("size"), F.col("intermediate").alias("name"), agree.alias("agrees")))
    n = lambda c: F.sum(c.cast("bigint"))
    out = paths.groupBy("source", "state", "distal").agg(F.count(F.lit(1)).alias("paths"), n(agree).alias("agreeing_paths"), n(~agree).alias("conflicting_paths"), best.alias("b"))
    return out.select("source", "state", F.col("distal").alias("response"), "paths", "agreeing_paths", "conflicting_paths",
                      F.col("b.name").alias("strongest_intermediate"), F.col("b.agrees").alias("strongest_agrees"))


def edge_evidence(effects: DataFrame, prior: DataFrame, motifs: DataFrame, contacts: DataFrame, units: DataFrame, promoters: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per response edge with supports, signs, class, tier and contradiction.

    effects(source, state, response, effect); prior as from ``curate_edges``;
    motifs(source, response); contacts(response, state, active_links,
    occupied_enhancer_links); units(source, state, cis, guide_concordant,
    occupancy_compatible); promoters(response, promoter_peaks); paths as from
    ``two_hop_paths``.
    """
    j = effects.join(prior.select("source", "response", "prior_direction", "direction_conflict", F.lit(True).alias("curated")), ["source", "response"], "left")
    j = j.join(motifs.select("source", "response").distinct().withColumn("motif", F.lit(True)), ["source", "response"], "left")
    j = j.join(contacts.select("response", "state", "active_links", "occupied_enhancer_links"), ["response", "state"], "left")
    j = j.join(units.select("source", "state", "cis", "guide_concordant", "occupancy_compatible"), ["source", "state"], "left")
    j = j.join(promoters.select("response", "promoter_peaks"), "response", "left")
    j = j.join(paths.select("source", "state", "response", "paths"), ["source", "state", "response"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = j.withColumns({
        "curated": yes("curated"), "motif": yes("motif"), "guide_concordant": yes("guide_concordant"), "prior_direction": count("prior_direction"),
        "direction_conflict": yes("direction_conflict"), "physical_active": count("active_links") > 0,
        "promoter_bound": yes("occupancy_compatible") & (count("promoter_peaks") > 0), "enhancer_linked": yes("occupancy_compatible") & (count("occupied_enhancer_links") > 0)})
    j = j.withColumn("expected_sign", (F.signum("cis") * F.col("prior_direction")).cast("int"))
    signed = F.col("prior_direction") != 0
    j = j.withColumn("agrees", signed & F.coalesce(F.signum("effect") == F.col("expected_sign"), F.lit(False)))
    j = j.withColumns({
        "contradiction": (signed & ~F.col("agrees")) | F.col("direction_conflict"), "higher_order": (count("paths") > 0) & ~F.col("curated"),
        "types": sum((F.col(c).cast("int") for c in ("curated", "motif", "physical_active")), (F.col("promoter_bound") | F.col("enhancer_linked")).cast("int"))})
    klass = priority_class(list(zip([F.col("enhancer_linked"), F.col("promoter_bound"), F.col("motif"), F.col("curated"), F.col("higher_order")], EDGE_CLASSES)), EDGE_CLASSES[-1])
    tier = priority_class([
        (F.col("enhancer_linked") & F.col("physical_active") & F.col("guide_concordant") & ~F.col("contradiction"), TIERS[0]),
        (F.col("curated") & signed & F.col("agrees") & (F.col("types") >= 3), TIERS[1]), ((F.col("types") >= 2) & ~F.col("contradiction"), TIERS[2])], TIERS[3])
    status = F.when(signed, F.when(F.col("agrees"), "concordant").otherwise("contradictory")).when(F.col("direction_conflict"), "conflicting_direction").otherwise("unavailable")
    return j.select("source", "state", "response", "effect", "curated", "motif", "physical_active", "promoter_bound", "enhancer_linked", "guide_concordant", "prior_direction", "agrees",
                    "contradiction", "types", klass.alias("edge_class"), tier.alias("tier"), status.alias("direction_status"))


def edge_fractions(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tier and class counts and fractions, direct support and path depth per unit."""
    n = lambda c: F.sum(c.cast("bigint"))
    safe = lambda name: name.lower().replace(" ", "_").replace("-", "_")
    counts = {safe(t): F.col("tier") == t for t in TIERS} | {safe(c): F.col("edge_class") == c for c in EDGE_CLASSES}
    g = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("edges"), *[n(c).alias(k) for k, c in counts.items()],
                               F.avg(F.when(F.col("prior_direction") != 0, F.col("agrees").cast("double"))).alias("direction_agreement"))
    direct = F.col("promoter_bound") + F.col("enhancer_linked") + F.col("motif_supported") + F.col("one_step")
    g = g.withColumn("direct", direct)
    d = lambda c: c.cast("double")
    return g.select("*", *[F.try_divide(d(F.col(k)), d(F.col("edges"))).alias(f"{k}_fraction") for k in counts], F.try_divide(d(F.col("direct")), d(F.col("edges"))).alias("direct_fraction"),
                    F.try_divide(d(F.col("direct") + 2 * F.col("higher_order")), d(F.col("direct") + F.col("higher_order"))).alias("path_depth"))


# component -> the supports it removes
COMPONENTS = {"none": (), "motif": ("motif",), "curated": ("curated",), "occupancy": ("promoter_bound", "enhancer_linked"), "physical_link": ("enhancer_linked",)}


def component_ablation(edges: DataFrame, unit: Sequence[str], groups: DataFrame, positive: str, negative: str) -> DataFrame:
    """Direct support with one evidence source removed, and the group difference
    of per-unit fractions. ``groups`` maps unit to ``group``.

    All components are counted in one aggregation per unit.
    """
    supports = ("motif", "curated", "promoter_bound", "enhancer_linked")

    def direct(component: str) -> Column:
        kept = [F.col(s) for s in supports if s not in COMPONENTS[component]]
        out = kept[0]
        for c in kept[1:]:
            out = out | c
        return F.sum(out.cast("bigint"))

    per = edges.groupBy(*unit).agg(F.count(F.lit(1)).alias("edges"), *[direct(c).alias(c) for c in COMPONENTS]).join(groups.select(*unit, "group"), list(unit), "left")
    long = per.unpivot([*unit, "group", "edges"], list(COMPONENTS), "removed_component", "direct")
    share = F.col("direct") / F.col("edges")
    return long.groupBy("removed_component").agg(
        F.sum("edges").alias("edges"), F.sum("direct").alias("direct_edges"), (F.sum("direct") / F.sum("edges")).alias("direct_fraction"),
        (F.avg(F.when(F.col("group") == positive, share)) - F.avg(F.when(F.col("group") == negative, share))).alias("group_difference"))


def threshold_sensitivity(edges: DataFrame, contacts: DataFrame, thresholds: Sequence[float], rules: Sequence[str] = ("both", "either")) -> DataFrame:
    """Edges with an active contact over a threshold x activity-rule grid.

    Only the best active score per (response, state, rule) matters, so the grid
    is applied to that maximum instead of re-scanning contacts per setting. Of
    the edges only the number per (response, state) does.
    """
    active = {"both": F.col("open") & F.col("marked"), "either": F.col("open") | F.col("marked")}
    best = contacts.groupBy("response", "state").agg(*[F.max(F.when(active[r], F.col("score"))).alias(r) for r in rules])
    j = edges.groupBy("response", "state").agg(F.count(F.lit(1)).alias("__n")).join(best, ["response", "state"], "left")
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(t)).alias("threshold"), F.sum(F.when(F.col(r) > t, F.col("__n")).otherwise(0)).alias("physical_active_edges"))
                      for r in rules for t in thresholds])
    out = j.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("edges"), cells.alias("c")).select("edges", F.explode("c").alias("c")).select("edges", "c.*")
    return out.withColumn("active_fraction", F.col("physical_active_edges") / F.col("edges"))


def direction_universe(cis: DataFrame, trans: DataFrame, features: DataFrame, effects: DataFrame, states: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """cis x trans associations on a variant with staged exclusions.

    Returns (universe per state with the oriented trans z, the stage counts).
    A state is kept for a mediator that has a response row in it; a missing
    response value is an implicit zero.
    """
    from statewise.operators.contracts import exclusion_flow

    c = cis.select("snp", F.col("gene").alias("mediator"), F.col("assessed").alias("ca"), F.col("other").alias("co"), F.col("z").alias("cis_z"))
    t = trans.select("snp", F.col("gene").alias("feature"), F.col("assessed").alias("ta"), F.col("other").alias("to"), F.col("z").alias("trans_z"))
    j = c.join(t, "snp").join(features.select("feature").distinct().withColumn("measured", F.lit(True)), "feature", "left")
    j = j.withColumn("orientation", orient_alleles(F.col("ca"), F.col("co"), F.col("ta"), F.col("to")))
    rules = [("not_measured", F.col("measured").isNull()), ("palindromic", is_palindromic(F.col("ca"), F.col("co")) | is_palindromic(F.col("ta"), F.col("to"))),
             ("unresolved_orientation", F.col("orientation") == 0)]
    flow = exclusion_flow(j, rules, "snp")
    kept = j
    for _, bad in rules:
        kept = kept.filter(~F.coalesce(bad, F.lit(False)))
    rows = effects.filter(F.col("state").isin(*states)).select(F.col("target").alias("mediator"), "state").distinct()
    u = kept.join(rows, "mediator").join(effects.select(F.col("target").alias("mediator"), "state", "feature", "value"), ["mediator", "state", "feature"], "left")
    return u.select("snp", "mediator", "feature", "state", "cis_z", (F.col("trans_z") * F.col("orientation")).alias("trans_z"), F.coalesce("value", F.lit(0.0)).alias("effect")), flow
