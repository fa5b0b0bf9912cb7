"""Join operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewise.operators import intervals as iv
from statewise.operators import joins as jn
from statewise.operators import matching as mt
from statewise.plans.bindings import DUCK, q6
from statewise.plans.registry import query, with_views

D = DUCK
STATES = ("A", "N", "R")


@query("d1_validated_join", lambda: with_views("summary", f"""
    SELECT target, state, cells, p_brand, p_size FROM summary JOIN part ON p_partkey = target"""))
def _(b):
    part = b.table("part").select(F.col("p_partkey").alias("target"), "p_brand", "p_size")
    return jn.validated_join(b.view("summary"), part, ["target"], "inner", "m:1").select("target", "state", "cells", "p_brand", "p_size")


@query("d2_semi_filter", lambda: """
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)
      AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def _(b):
    keys = {"l_partkey": b.table("part").filter("p_size < 10"), "l_suppkey": b.table("supplier").filter("s_acctbal > 0")}
    return jn.semi_filter(b.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), keys).select("l_orderkey", "l_linenumber")


@query("d2_anti_filter", lambda: """
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def _(b):
    rich = b.table("orders").filter("o_totalprice > 200000").select("o_custkey")
    return jn.anti_filter(b.table("customer").select("c_custkey"), {"c_custkey": rich})


@query("d3_pairing_audit", lambda: """
    SELECT count(*) FILTER (WHERE a AND z) AS both, count(*) FILTER (WHERE z IS NULL) AS left_only, count(*) FILTER (WHERE a IS NULL) AS right_only,
      count(*) FILTER (WHERE a AND z AND x IS NOT DISTINCT FROM y) AS label_agrees, count(*) FILTER (WHERE a AND z AND x IS DISTINCT FROM y) AS label_differs
    FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS x, true AS a FROM lineitem WHERE l_quantity > 10) f
    FULL OUTER JOIN (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN 'A' ELSE 'N' END AS y, true AS z FROM lineitem WHERE l_quantity < 40) g
    USING (l_orderkey, l_linenumber)""")
def _(b):
    t = b.table("lineitem")
    left = t.filter("l_quantity > 10").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"))
    right = t.filter("l_quantity < 40").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.04, "A").otherwise("N").alias("label"))
    return jn.pairing_audit(left, right, ["l_orderkey", "l_linenumber"], "label")


@query("d4_points_in_intervals", lambda: with_views("points spans", """
    SELECT point_id, span_id, assay FROM points p JOIN spans s ON p.chrom = s.chrom AND start_pos <= pos AND pos < end_pos"""))
def _(b):
    return iv.points_in_intervals(b.view("points"), b.view("spans")).select("point_id", "span_id", "assay")


@query("d4_covered_mass", lambda: with_views("points spans", f"""
    SELECT assay, sum(c)::BIGINT AS hits, count(*) AS points, {D.q6('sum(w)')} AS mass FROM (
      SELECT assay, point_id, max(weight) AS w, count(*) AS c FROM points p JOIN spans s ON p.chrom = s.chrom AND start_pos <= pos AND pos < end_pos
      GROUP BY assay, point_id) GROUP BY assay"""))
def _(b):
    return iv.covered_mass(b.view("points"), b.view("spans"), "point_id", "weight", "assay").withColumn("mass", q6("mass"))


@query("d5_interval_overlap_count", lambda: with_views("spans", """
    SELECT a.span_id, count(z.span_id) AS overlaps FROM spans a LEFT JOIN spans z
      ON a.chrom = z.chrom AND z.assay = 'marked' AND z.start_pos < a.end_pos AND z.end_pos > a.start_pos
    WHERE a.assay = 'open' GROUP BY a.span_id"""))
def _(b):
    s = b.view("spans")
    return iv.interval_overlap_count(s.filter("assay = 'open'"), s.filter("assay = 'marked'"), "span_id").select("span_id", "overlaps")


@query("d6_nearest_interval", lambda: with_views("points spans", """
    SELECT point_id, min(CASE WHEN start_pos IS NULL THEN NULL WHEN start_pos <= pos AND pos < end_pos THEN 0 WHEN pos < start_pos THEN greatest(0, start_pos - (pos + 1))
      ELSE greatest(0, pos - end_pos) END) AS distance
    FROM points p LEFT JOIN spans s ON p.chrom = s.chrom AND s.chrom % 7 <> 0 GROUP BY point_id"""))
def _(b):
    out = iv.nearest_interval(b.view("points"), b.view("spans").filter("chrom % 7 <> 0"))
    return out.select("point_id", F.col("distance").cast("bigint").alias("distance"))


def _blocks_sql(d):
    hour = f"cast(floor({d.epoch('ts')} / 3600) as bigint)"
    return f"""SELECT DISTINCT user_id AS chrom, {hour} * 3600 AS block_start, {hour} * 3600 + 3000 AS block_end,
      user_id + CASE WHEN {hour} % 11 = 0 THEN 1 ELSE 0 END AS to_chrom, {hour} * 3600 + 1000000 + dup * 5 AS to_start,
      CASE WHEN {hour} % 3 = 0 THEN '-' ELSE '+' END AS strand, 1 AS score
    FROM {d.t('events')} {'LATERAL VIEW explode(array(0, 1)) x AS dup' if d.spark else ', (VALUES (0), (1)) x(dup)'}
    WHERE dup = 0 OR {hour} % 5 = 0"""


def _lift_sql():
    return with_views("spans", f""", blocks AS ({_blocks_sql(D)}),
    ends AS (SELECT span_id, chrom, 'first' AS side, start_pos AS pos FROM spans WHERE end_pos > start_pos
             UNION ALL SELECT span_id, chrom, 'last', end_pos - 1 FROM spans WHERE end_pos > start_pos),
    hits AS (SELECT span_id, side, to_chrom, strand, score, to_start + CASE WHEN strand = '+' THEN pos - block_start ELSE block_end - 1 - pos END AS to_pos
             FROM ends e JOIN blocks k ON e.chrom = k.chrom AND block_start <= pos AND pos < block_end),
    top AS (SELECT *, max(score) OVER (PARTITION BY span_id, side) AS best, count(*) OVER (PARTITION BY span_id, side) AS cand FROM hits),
    side1 AS (SELECT span_id, side, max(cand) AS cand, count(DISTINCT (to_chrom, to_pos, strand)) AS places, min(to_chrom) AS to_chrom, min(to_pos) AS to_pos, min(strand) AS strand
              FROM top WHERE score = best GROUP BY span_id, side),
    j AS (SELECT s.span_id, f.span_id IS NOT NULL AS fh, l.span_id IS NOT NULL AS lh, f.places AS fp, l.places AS lp, coalesce(f.cand, 0) AS first_candidates,
             coalesce(l.cand, 0) AS last_candidates, f.to_chrom AS fc, l.to_chrom AS lc, f.strand AS fs, l.strand AS ls, f.to_pos AS fpos, l.to_pos AS lpos
          FROM spans s LEFT JOIN side1 f ON f.span_id = s.span_id AND f.side = 'first' LEFT JOIN side1 l ON l.span_id = s.span_id AND l.side = 'last'),
    st AS (SELECT *, CASE WHEN NOT fh THEN 'unmapped_endpoint' WHEN fp > 1 THEN 'ambiguous_best_endpoint' WHEN NOT lh THEN 'unmapped_endpoint' WHEN lp > 1 THEN 'ambiguous_best_endpoint'
             WHEN fc <> lc THEN 'endpoint_chromosome_mismatch' WHEN fs <> ls THEN 'endpoint_orientation_mismatch' ELSE 'mapped' END AS status FROM j)
    SELECT span_id, status, first_candidates, last_candidates, CASE WHEN status = 'mapped' THEN fc END AS to_chrom,
      CASE WHEN status = 'mapped' THEN least(fpos, lpos) END AS to_start, CASE WHEN status = 'mapped' THEN greatest(fpos, lpos) + 1 END AS to_end,
      CASE WHEN status = 'mapped' THEN fs END AS to_strand FROM st""")


@query("d7_liftover", _lift_sql)
def _(b):
    return iv.liftover(b.view("spans"), b.spark.sql(_blocks_sql(b.dialect)), "span_id")


@query("d8_state_pairs", lambda: with_views("summary", f"""
    SELECT a.target, a.state AS left_state, z.state AS right_state, {D.q6('a.effect')} AS left_effect, {D.q6('z.effect')} AS right_effect
    FROM summary a JOIN summary z ON a.target = z.target AND a.state < z.state"""))
def _(b):
    p = jn.state_pairs(b.view("summary"), ["target"], "state", STATES, ["effect"])
    return p.withColumns({"left_effect": q6("left_effect"), "right_effect": q6("right_effect")})


@query("d9_candidate_pairs", lambda: with_views("edges", """
    SELECT s_suppkey AS regulator, p_partkey AS gene, CAST(g.response IS NOT NULL AS INT) AS gold
    FROM supplier JOIN part ON s_suppkey <> p_partkey
    LEFT JOIN (SELECT DISTINCT source, response FROM edges WHERE direction = 1) g ON g.source = s_suppkey AND g.response = p_partkey"""))
def _(b):
    genes = b.table("part").select(F.col("p_partkey").alias("gene"))
    regulators = b.table("supplier").select(F.col("s_suppkey").alias("regulator"))
    gold = b.view("edges").filter("direction = 1").select(F.col("source").alias("regulator"), F.col("response").alias("gene"))
    return jn.candidate_pairs(genes, regulators, gold)


@query("d11_matched_controls", lambda: """
    WITH u AS (SELECT p_brand AS stratum, p_partkey AS unit, p_size = 1 AS is_case, ln(p_retailprice) AS c1, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_size END AS c2 FROM part),
    f AS (SELECT *, coalesce(c2, quantile_cont(c2::DOUBLE, 0.5) OVER (PARTITION BY stratum)) AS d2 FROM u),
    s AS (SELECT *, c1 / stddev_pop(c1) OVER w AS z1, d2 / stddev_pop(d2) OVER w AS z2 FROM f WINDOW w AS (PARTITION BY stratum)),
    k AS (SELECT a.stratum, a.unit AS case_unit, b.unit AS control_unit, sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)) AS distance,
      row_number() OVER (PARTITION BY a.unit ORDER BY sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)), b.unit) AS slot
      FROM s a JOIN s b ON a.stratum = b.stratum AND a.is_case AND NOT b.is_case)
    SELECT stratum, case_unit, control_unit, slot, floor(distance * 1e6 + 0.4937) / 1e6 AS distance FROM k WHERE slot <= 5
    QUALIFY max(distance) OVER (PARTITION BY case_unit) <= 0.9""")
def _(b):
    units = b.table("part").select(
        F.col("p_brand").alias("stratum"), F.col("p_partkey").alias("unit"), (F.col("p_size") == 1).alias("is_case"),
        F.log("p_retailprice").alias("c1"), F.when(F.col("p_partkey") % 29 != 0, F.col("p_size")).alias("c2"))
    out = mt.matched_controls(units, ["stratum"], "unit", "is_case", ["c1", "c2"], 5, 0.9)
    return out.withColumn("distance", q6("distance"))


@query("d12_nearest_match", lambda: f"""
    WITH c AS (SELECT p_partkey, ln(1 + p_retailprice) AS a, p_size AS z FROM part),
    s AS (SELECT stddev_pop(a) AS sa, stddev_pop(z) AS sz FROM c WHERE p_partkey <> 7), e AS (SELECT a AS ea, z AS ez FROM c WHERE p_partkey = 7)
    SELECT p_partkey, {D.q6('sqrt(pow((a - ea) / sa, 2) + pow((z - ez) / sz, 2))')} AS match_distance FROM c, s, e WHERE p_partkey <> 7
    ORDER BY sqrt(pow((a - ea) / sa, 2) + pow((z - ez) / sz, 2)), p_partkey LIMIT 25""")
def _(b):
    p = b.table("part")
    out = mt.nearest_match(p.filter("p_partkey <> 7"), p.filter("p_partkey = 7"), ["p_retailprice", "p_size"], ["p_retailprice"], "p_partkey", 25)
    return out.select("p_partkey", q6("match_distance").alias("match_distance"))


@query("d13_assemble_feature_blocks", lambda: with_views("summary tensor", f"""
    , m AS (SELECT target, avg(score) FILTER (WHERE module = 0) AS m0, avg(score) FILTER (WHERE module = 1) AS m1 FROM tensor GROUP BY target),
    c AS (SELECT target, quantile_cont(cells::DOUBLE, 0.5) AS cells, avg(effect) AS mean_effect, stddev_samp(effect) AS sd_effect, min(effect) AS lo, max(effect) AS hi FROM summary GROUP BY target),
    f AS (SELECT target, count(*) FILTER (WHERE effect > 0)::DOUBLE / count(*) AS positive FROM summary GROUP BY target)
    SELECT s_suppkey AS target, {D.q6('cells')} AS proximal_cells, {D.q6('mean_effect')} AS proximal_mean_effect, {D.q6('sd_effect')} AS proximal_sd_effect,
      {D.q6('lo')} AS proximal_lo, {D.q6('hi')} AS proximal_hi, {D.q6('positive')} AS class_positive, {D.q6('m0')} AS vector_m0, {D.q6('m1')} AS vector_m1
    FROM supplier s LEFT JOIN c ON c.target = s_suppkey LEFT JOIN f ON f.target = s_suppkey LEFT JOIN m ON m.target = s_suppkey"""))
def _(b):
    s = b.view("summary")
    proximal = s.groupBy("target").agg(
        F.percentile(F.col("cells").cast("double"), 0.5).alias("cells"), F.avg("effect").alias("mean_effect"), F.stddev_samp("effect").alias("sd_effect"),
        F.min("effect").alias("lo"), F.max("effect").alias("hi"))
    share = s.groupBy("target").agg(F.avg((F.col("effect") > 0).cast("double")).alias("positive"))
    modules = jn.pivot_mean(b.view("tensor"), "target", "module", [0, 1], "score", "m")
    base = b.table("supplier").select(F.col("s_suppkey").alias("target"))
    out = jn.assemble_feature_blocks(base, "target", {"proximal": proximal, "class": share, "vector": modules})
    return out.select("target", *[q6(c).alias(c) for c in out.columns if c != "target"])


def _genes(b):
    return b.table("part").select(
        F.col("p_partkey").alias("gene"), (F.col("p_partkey") % 150).alias("chrom"),
        (F.lit(1704067200) + F.col("p_partkey") * 1000).alias("gene_start"), (F.lit(1704067200) + F.col("p_partkey") * 1000 + F.col("p_size") * 60).alias("gene_end"),
        F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("strand"))


@query("d15_gene_promoter_windows", lambda: with_views("spans", """
    , g AS (SELECT p_partkey AS gene, p_partkey % 150 AS chrom, 1704067200 + p_partkey * 1000 AS gs, 1704067200 + p_partkey * 1000 + p_size * 60 AS ge, p_size % 2 = 0 AS plus FROM part),
    t AS (SELECT *, CASE WHEN plus THEN gs ELSE ge END - 1 AS tss FROM g),
    w AS (SELECT *, greatest(0, tss - CASE WHEN plus THEN 2000 ELSE 500 END) AS start_pos, tss + CASE WHEN plus THEN 500 ELSE 2000 END AS end_pos, ge - gs + 1 AS gene_length FROM t)
    SELECT gene, w.chrom, tss, w.start_pos, w.end_pos, gene_length, count(s.span_id) AS peaks FROM w LEFT JOIN spans s ON s.chrom = w.chrom AND s.start_pos < w.end_pos AND s.end_pos > w.start_pos
    GROUP BY ALL"""))
def _(b):
    w = iv.gene_promoter_windows(_genes(b)).select("gene", "chrom", "tss", "start_pos", "end_pos", "gene_length")
    return iv.interval_overlap_count(w, b.view("spans"), "gene", out="peaks")


def _contacts(b):
    q = F.col("l_quantity")
    return b.table("lineitem").select(
        F.col("l_partkey").alias("gene"), (q / 5).alias("resting"), (q * (1 - F.col("l_discount") * 4) / 5).alias("activated"),
        (F.col("l_linestatus") == "O").alias("open"), (F.col("l_tax") > 0.03).alias("marked"),
        (F.col("l_linenumber") % 3).alias("prey_count"), (F.col("l_linenumber") % 2).alias("bait_count"))


CONTACTS_SQL = """contacts AS (SELECT l_partkey AS gene, l_quantity / 5 AS resting, l_quantity * (1 - l_discount * 4) / 5 AS activated, l_linestatus = 'O' AS open,
      l_tax > 0.03 AS marked, l_linenumber % 3 AS prey_count, l_linenumber % 2 AS bait_count FROM lineitem),
    x AS (SELECT *, 'Rest' AS state, resting AS score FROM contacts UNION ALL SELECT *, 'Stim', activated FROM contacts)"""


@query("d16_contact_support", lambda: f"""
    WITH {CONTACTS_SQL} SELECT gene, state, count(*) AS called_links, count(*) FILTER (WHERE open AND marked) AS active_links,
      count(*) FILTER (WHERE open AND marked AND prey_count > 0) AS occupied_enhancer_links, count(*) FILTER (WHERE bait_count > 0) AS occupied_promoter_links
    FROM x WHERE score > 5 GROUP BY gene, state""")
def _(b):
    return iv.contact_support(_contacts(b), {"Rest": "resting", "Stim": "activated"}, 5.0)


@query("d18_pair_partner_features", lambda: f"""
    WITH att AS (SELECT l_suppkey AS guide, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, count(*) FILTER (WHERE l_quantity > 40) AS hits,
        count(*) FILTER (WHERE l_tax > 0.07)::DOUBLE AS quality FROM lineitem GROUP BY l_suppkey),
    p AS (SELECT DISTINCT l_orderkey % 500 AS pair, l_suppkey AS guide_1, (l_suppkey * 7 + 3) % 100 AS guide_2, 200 AS n_union FROM lineitem),
    j AS (SELECT p.*, a.n AS n1, c.n AS n2, a.mean AS m1, c.mean AS m2, a.std AS s1, c.std AS s2, a.hits AS h1, c.hits AS h2, a.quality AS q1, c.quality AS q2,
        a.hits + c.hits - n_union AS ov, c.mean - a.mean AS dm, ln(1 + c.hits) - ln(1 + a.hits) AS dh FROM p LEFT JOIN att a ON a.guide = guide_1 LEFT JOIN att c ON c.guide = guide_2)
    SELECT pair, guide_1, guide_2, CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN least(n1, n2) END AS min_n,
      CASE WHEN q1 IS NOT NULL AND q2 IS NOT NULL THEN greatest(q1, q2) END AS any_quality, (q1 + q2) / 2 AS mean_quality,
      CASE WHEN n1 IS NULL OR n2 IS NULL THEN 'metadata_unavailable' WHEN least(n1, n2) < 580 THEN 'low_cell_count' ELSE 'eligible' END AS eligibility,
      {D.q6('dm')} AS mean_difference, {D.q6('abs(dm)')} AS mean_absolute_difference, {D.q6('dh')} AS count_difference,
      CASE WHEN dm <> 0 AND dh <> 0 THEN (sign(dm) = sign(dh))::INT::DOUBLE END AS sign_agreement,
      (ov >= 0 AND ov <= CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN least(h1, h2) END) AS overlap_valid,
      {D.q6('CASE WHEN ov >= 0 AND ov <= least(h1, h2) AND n_union > 0 THEN ov::DOUBLE / n_union END')} AS jaccard,
      {D.q6('CASE WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN sqrt((s1 * s1 / n1 + s2 * s2 / n2) / pow(least(m1, m2), 2)) END')} AS difference_se FROM j""")
def _(b):
    t = b.table("lineitem")
    n = lambda c: F.sum(c.cast("bigint"))
    att = t.groupBy(F.col("l_suppkey").alias("guide")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("std"),
        n(F.col("l_quantity") > 40).alias("hits"), n(F.col("l_tax") > 0.07).cast("double").alias("quality"))
    pairs = t.select(
        (F.col("l_orderkey") % 500).alias("pair"), F.col("l_suppkey").alias("guide_1"), ((F.col("l_suppkey") * 7 + 3) % 100).alias("guide_2"),
        F.lit(200).alias("n_union")).distinct()
    out = jn.pair_partner_features(pairs, att, "guide", ["n", "mean", "std", "hits", "quality"], 580)
    keep = ["pair", "guide_1", "guide_2", "min_n", "any_quality", "mean_quality", "eligibility", "mean_difference", "mean_absolute_difference",
            "count_difference", "sign_agreement", "overlap_valid", "jaccard", "difference_se"]
    rounded = {"mean_difference", "mean_absolute_difference", "count_difference", "jaccard", "difference_se"}
    return out.select(*[q6(c).alias(c) if c in rounded else F.col(c) for c in keep])


@query("g9_matched_slot_null", lambda: f"""
    WITH m AS (SELECT l_orderkey AS set_id, l_linenumber AS slot, l_returnflag = 'R' AS hit FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 3),
    a AS (SELECT set_id, slot, hit::INT::DOUBLE AS v, row_number() OVER (PARTITION BY set_id ORDER BY slot, hit) - 1 AS i, count(*) OVER (PARTITION BY set_id) AS n, sum(hit::INT::DOUBLE) OVER (PARTITION BY set_id) AS t FROM m),
    r AS (SELECT r AS replicate, set_id, n, t, v FROM a, range(25) x(r) WHERE i = {D.draw('n', "'7'", 'r', 'set_id')})
    SELECT replicate, {D.q6('avg(v - (t - v) / (n - 1))')} AS excess, count(*) AS sets FROM r GROUP BY replicate""")
def _(b):
    t = b.table("lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("slot"), (F.col("l_returnflag") == "R").alias("hit"))
    big = t.groupBy("set_id").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3").select("set_id")
    out = mt.matched_slot_null(t.join(big, "set_id"), [], "set_id", "slot", "hit", 25, 7)
    return out.withColumn("excess", q6("excess"))
