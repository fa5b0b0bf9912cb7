"""Grouped and ranked queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewise.operators import groups as gr
from statewise.operators import ranks as rk
from statewise.plans.bindings import DUCK, q6
from statewise.plans.registry import query, with_views

D = DUCK
STATES = ("A", "N", "R")


def r6(df, *columns):
    return df.withColumns({c: q6(c) for c in columns})


CLASSED = "CASE WHEN effect <= -0.01 THEN 'buffered' WHEN effect >= 0.01 THEN 'amplified' ELSE 'intermediate' END"


@query("e1_group_summary", lambda: f"""
    SELECT l_returnflag, count(*) AS n_rows, count(l_extendedprice) AS n_values, {D.q6('avg(l_extendedprice)', 4)} AS mean, {D.q6('stddev_samp(l_extendedprice)', 4)} AS sd,
      min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum, count(DISTINCT l_suppkey) AS n_units, {D.q6('quantile_cont(l_extendedprice, 0.5)')} AS median,
      {D.q6('quantile_cont(l_extendedprice, 0.05)')} AS q05, {D.q6('quantile_cont(l_extendedprice, 0.95)')} AS q95 FROM lineitem GROUP BY l_returnflag""")
def _(b):
    out = gr.group_summary(b.table("lineitem"), ["l_returnflag"], "l_extendedprice", "l_suppkey", {"q05": 0.05, "q95": 0.95})
    return r6(out, "median", "q05", "q95").withColumns({"mean": q6("mean", 4), "sd": q6("sd", 4)})


@query("e2_context_summary", lambda: with_views("summary", f"""
    , c AS (SELECT *, {CLASSED} AS klass FROM summary), n AS (SELECT target, cluster, count(*)::DOUBLE AS c FROM summary WHERE cluster IS NOT NULL GROUP BY ALL),
    h AS (SELECT target, -sum(c / t * ln(c / t)) / ln(3) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY target) AS t FROM n) GROUP BY target)
    SELECT target, {D.q6('max(effect) - min(effect)')} AS value_range, {D.q6('stddev_samp(effect)')} AS value_sd, {D.q6('min(effect)')} AS value_min, {D.q6('max(effect)')} AS value_max,
      count(*) FILTER (WHERE klass = 'amplified') AS amplified, count(*) FILTER (WHERE klass = 'buffered') AS buffered, count(cluster) AS cluster_rows,
      count(DISTINCT cluster) AS distinct_clusters, {D.q6('CASE WHEN count(*) = 3 THEN coalesce(max(h), 0) END')} AS cluster_entropy,
      CASE WHEN count(cluster) = 3 THEN count(DISTINCT cluster) > 1 END AS cluster_switch FROM c LEFT JOIN h USING (target) GROUP BY target"""))
def _(b):
    s = b.view("summary").withColumn("klass", F.expr(CLASSED))
    return r6(gr.context_summary(s, "target", "effect", "klass", "cluster"), "value_range", "value_sd", "value_min", "value_max", "cluster_entropy")


@query("e3_complete_cohort", lambda: with_views("passed", """
    SELECT target, state, cells FROM passed WHERE target IN (SELECT target FROM passed GROUP BY target HAVING count(DISTINCT state) = 3)"""))
def _(b):
    return gr.complete_cohort(b.view("passed"), ["target"], "state", STATES).select("target", "state", "cells")


@query("e4_normalised_entropy", lambda: f"""
    , n AS (SELECT l_orderkey, l_returnflag, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, {D.q6('CASE WHEN sum(c) = 3 THEN -sum(c / t * ln(c / t)) / ln(3) END')} AS entropy
    FROM (SELECT *, sum(c) OVER (PARTITION BY l_orderkey) AS t FROM n) GROUP BY l_orderkey""".replace(", n AS", "WITH n AS", 1))
def _(b):
    return r6(gr.normalised_entropy(b.table("lineitem"), ["l_orderkey"], "l_returnflag"), "entropy")


@query("e5_class_fractions", lambda: f"""
    SELECT l_suppkey, {', '.join(D.q6(f"count(*) FILTER (WHERE l_returnflag = '{s}')::DOUBLE / count(*)") + f' AS fraction_{s}' for s in STATES)} FROM lineitem GROUP BY l_suppkey""")
def _(b):
    return r6(gr.class_fractions(b.table("lineitem"), ["l_suppkey"], "l_returnflag", STATES), *[f"fraction_{s}" for s in STATES])


@query("e6_pivot_complete", lambda: with_views("passed", """
    SELECT * FROM (SELECT target, max(cells) FILTER (WHERE state = 'A') AS "cells_A", max(cells) FILTER (WHERE state = 'N') AS "cells_N", max(cells) FILTER (WHERE state = 'R') AS "cells_R"
      FROM passed GROUP BY target) WHERE "cells_A" IS NOT NULL AND "cells_N" IS NOT NULL AND "cells_R" IS NOT NULL"""))
def _(b):
    return gr.pivot_complete(b.view("passed"), ["target"], "state", STATES, "cells")


@query("e6_unpivot_states", lambda: with_views("passed", """
    SELECT target, state, cells FROM passed WHERE target IN (SELECT target FROM passed GROUP BY target HAVING count(*) = 3)"""))
def _(b):
    return gr.unpivot_states(gr.pivot_complete(b.view("passed"), ["target"], "state", STATES, "cells"), ["target"], STATES, "cells")


@query("e7_pattern_key", lambda: with_views("passed", """
    SELECT pattern, count(*) AS targets FROM (SELECT target, string_agg(state, '|' ORDER BY state) AS pattern FROM passed GROUP BY target) GROUP BY pattern"""))
def _(b):
    return gr.pattern_key(b.view("passed"), ["target"], "state").groupBy("pattern").agg(F.count(F.lit(1)).alias("targets"))


@query("e8_density_histogram", lambda: f"""
    WITH h AS (SELECT l_returnflag, least(floor((least(greatest(l_extendedprice, 5000.0), 85000.0) - 5000.0) / 1000.0), 79)::INT AS bin, count(*) AS c FROM lineitem GROUP BY ALL)
    SELECT t.l_returnflag, g.bin::INT AS bin, 5000.0::DOUBLE + g.bin * 1000.0 AS bin_left, 5000.0::DOUBLE + (g.bin + 1) * 1000.0 AS bin_right, coalesce(c, 0) AS count, {D.q6('coalesce(c, 0)::DOUBLE / (total * 1000.0)', 9)} AS density
    FROM (SELECT l_returnflag, count(*) AS total FROM lineitem GROUP BY 1) t CROSS JOIN range(80) g(bin) LEFT JOIN h ON h.l_returnflag = t.l_returnflag AND h.bin = g.bin""")
def _(b):
    out = gr.density_histogram(b.table("lineitem"), "l_extendedprice", 5000.0, 85000.0, 80, "l_returnflag")
    return out.withColumn("density", q6("density", 9))


def _cell_triplets(b):
    """Cells = orders grouped by priority; feature = brand; value = quantity."""
    li = b.table("lineitem").join(b.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(b.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    trip = li.filter("l_quantity > 10").groupBy(F.col("o_orderpriority").alias("grp"), "l_orderkey", F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    sizes = b.table("orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return trip, sizes


CELLS_SQL = """trip AS (SELECT o_orderpriority AS grp, l_orderkey, p_brand AS feature, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN part ON p_partkey = l_partkey WHERE l_quantity > 10 GROUP BY ALL), sizes AS (SELECT o_orderpriority AS grp, count(*) AS n FROM orders GROUP BY 1),
    m AS (SELECT grp, feature, n, sum(value) / n AS mean, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1) AS variance FROM trip JOIN sizes USING (grp) GROUP BY grp, feature, n)"""


@query("e9_implicit_zero_moments", lambda: f"WITH {CELLS_SQL} SELECT grp, feature, n, {D.q6('mean')} AS mean, {D.q6('variance', 4)} AS variance FROM m")
def _(b):
    trip, sizes = _cell_triplets(b)
    return r6(gr.implicit_zero_moments(trip, sizes, "grp", "feature", "value"), "mean").withColumn("variance", q6("variance", 4))


@query("e10_welch_statistics", lambda: f"""
    WITH {CELLS_SQL}, j AS (SELECT a.grp, a.feature, a.n, a.mean - c.mean AS difference, a.variance / a.n AS va, c.variance / c.n AS vc, c.n AS cn FROM m a JOIN m c ON a.feature = c.feature AND c.grp = '5-LOW' AND a.grp <> '5-LOW')
    SELECT grp, feature, n, {D.q6('difference')} AS difference, {D.q6('difference / sqrt(greatest(va + vc, 2.2250738585072014e-308))')} AS statistic, {D.q6('pow(va + vc, 2) / nullif(va * va / greatest(n - 1, 1) + vc * vc / greatest(cn - 1, 1), 0)', 3)} AS freedom FROM j""")
def _(b):
    trip, sizes = _cell_triplets(b)
    out = gr.welch_statistics(trip, sizes, "grp", "feature", "value", "5-LOW")
    return r6(out, "difference", "statistic").withColumn("freedom", q6("freedom", 3))


@query("e10_welch_de")
def _(b):
    trip, sizes = _cell_triplets(b)
    return gr.welch_de(trip, sizes, "grp", "feature", "value", "5-LOW")


@query("e11_sufficient_stats", lambda: """
    SELECT l_returnflag, n, unnest(['l_quantity', 'l_quantity', 'l_quantity', 'c', 'c', 'y']) AS "left", unnest(['l_quantity', 'c', 'y', 'c', 'y', 'y']) AS "right", unnest([qq, qc, qy, cc, cy, yy]) AS total
    FROM (SELECT l_returnflag, count(*) AS n, sum(l_quantity * l_quantity) AS qq, sum(l_quantity * c) AS qc, sum(l_quantity * y) AS qy, sum(c * c) AS cc, sum(c * y) AS cy, sum(y * y) AS yy
      FROM (SELECT *, (l_linenumber % 5)::DOUBLE AS c, round(l_discount * 100)::DOUBLE AS y FROM lineitem) GROUP BY l_returnflag)""")
def _(b):
    t = b.table("lineitem").withColumns({"c": (F.col("l_linenumber") % 5).cast("double"), "y": F.round(F.col("l_discount") * 100)})
    return gr.sufficient_stats(t, ["l_returnflag"], ["l_quantity", "c"], "y")


@query("e12_partial_pool", lambda: with_views("passed", f"""
    , v AS (SELECT cluster, effect, 1.0::DOUBLE / cells AS variance FROM passed WHERE cluster IS NOT NULL), g AS (SELECT cluster, avg(effect) AS m, sum(1 / variance) AS pr, sum(effect / variance) AS wx FROM v GROUP BY cluster),
    o AS (SELECT sum(wx) / sum(pr) AS grand, var_samp(m) AS bt FROM g)
    SELECT cluster, {D.q6('m')} AS group_mean, {D.q6('bt / (bt + 1 / pr)')} AS shrinkage, {D.q6('bt / (bt + 1 / pr) * m + (1 - bt / (bt + 1 / pr)) * grand')} AS pooled FROM g, o"""))
def _(b):
    v = b.view("passed").filter("cluster IS NOT NULL").withColumn("variance", 1.0 / F.col("cells"))
    return r6(gr.partial_pool(v, "cluster", "effect", "variance"), "group_mean", "shrinkage", "pooled")


@query("e13_shrink_targets", lambda: with_views("passed", f"""
    , t AS (SELECT target, count(effect) AS observations, avg(effect) AS u, var_pop(effect) AS vp FROM passed GROUP BY target),
    s AS (SELECT sum(vp * observations) / sum(observations - 1) AS sigma2, var_samp(u) AS vu, avg(1.0::DOUBLE / observations) AS inv FROM t), c AS (SELECT sigma2, greatest(vu - sigma2 * inv, 0) AS tau2 FROM s)
    SELECT target, observations, {D.q6('u')} AS unshrunken, {D.q6('CASE WHEN tau2 = 0 THEN 0 ELSE tau2 / (tau2 + sigma2 / observations) END')} AS weight,
      {D.q6('CASE WHEN tau2 = 0 THEN 0 ELSE u * tau2 / (tau2 + sigma2 / observations) END')} AS shrunken FROM t, c"""))
def _(b):
    return r6(gr.shrink_targets(b.view("passed"), "target", "effect"), "unshrunken", "weight", "shrunken")


@query("e15_assignment_pairs", lambda: with_views("cells", f"""
    , c AS (SELECT dataset, cell_id, list_sort(list(DISTINCT label)) AS labels FROM cells GROUP BY dataset, cell_id UNION ALL
        SELECT o_orderpriority, o_orderkey, [] FROM orders WHERE o_orderkey NOT IN (SELECT cell_id FROM cells)),
    n AS (SELECT dataset, labels, count(*) AS k FROM c GROUP BY ALL), s AS (SELECT dataset, labels[1] AS t, k FROM n WHERE len(labels) = 1), z AS (SELECT dataset, k FROM n WHERE len(labels) = 0),
    p AS (SELECT n.dataset, labels[1] AS target_a, labels[2] AS target_b, concat_ws('|', labels[1], labels[2], n.dataset) AS pair_id, n.k AS pair_cells, coalesce(sa.k, 0) AS single_a_cells, coalesce(sb.k, 0) AS single_b_cells, coalesce(z.k, 0) AS control_cells
      FROM n LEFT JOIN s sa ON sa.dataset = n.dataset AND sa.t = labels[1] LEFT JOIN s sb ON sb.dataset = n.dataset AND sb.t = labels[2] LEFT JOIN z ON z.dataset = n.dataset WHERE len(labels) = 2),
    q AS (SELECT *, concat_ws(';', CASE WHEN pair_cells < 3 THEN 'few_pair_cells' END, CASE WHEN single_a_cells < 30 THEN 'few_single_a_cells' END, CASE WHEN single_b_cells < 30 THEN 'few_single_b_cells' END, CASE WHEN control_cells < 500 THEN 'few_control_cells' END) AS exclusion_reason FROM p)
    SELECT dataset, target_a, target_b, pair_id, 1 + {D.fold('pair_id', 5)} AS pair_fold, pair_cells, single_a_cells, single_b_cells, control_cells, exclusion_reason = '' AS cell_gate_pass, exclusion_reason FROM q"""))
def _(b):
    orders = b.table("orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("cell_id"))
    cells = orders.join(b.view("cells").select("cell_id", "label"), "cell_id", "left")
    return gr.assignment_pairs(cells, "dataset", "cell_id", "label", 3, 30, 500)


@query("e19_stable_variable_units", lambda: with_views("summary", f"""
    SELECT target, {D.q6('stddev_samp(cells) / avg(cells)')} AS variation, {D.q6('max(effect) - min(effect)')} AS spread FROM summary GROUP BY target HAVING stddev_samp(cells) / avg(cells) < 0.2501
    ORDER BY max(effect) - min(effect) DESC, target LIMIT 50"""))
def _(b):
    return r6(gr.stable_variable_units(b.view("summary"), "target", "cells", "effect", 0.2501, 50), "variation", "spread")


def _pairs(b):
    from statewise.operators.joins import state_pairs
    p = state_pairs(b.view("passed"), ["target"], "state", STATES, ["effect", "cells"])
    return p.select("target", "left_state", "right_state", F.abs(F.col("left_effect") - F.col("right_effect")).alias("gap"),
                    ((F.col("left_cells") > 5) & (F.col("right_cells") > 5)).alias("evaluable"))


@query("e20_state_from_pairs", lambda: with_views("passed", f"""
    , p AS (SELECT a.target, a.state AS l, z.state AS r, CASE WHEN a.cells > 5 AND z.cells > 5 THEN abs(a.effect - z.effect) END AS v FROM passed a JOIN passed z ON a.target = z.target AND a.state < z.state),
    s AS (SELECT target, l AS state, v FROM p UNION ALL SELECT target, r, v FROM p)
    SELECT target, state, count(*) AS pair_rows, count(v) AS evaluable_pairs, {D.q6('CASE WHEN count(*) = 2 AND count(v) = 2 THEN avg(v) END')} AS state_value FROM s GROUP BY target, state"""))
def _(b):
    return r6(gr.state_from_pairs(_pairs(b), "target", "gap", "evaluable"), "state_value")


@query("e21_control_delta", lambda: f"""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS obs, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_tax * 10 END AS r1, l_discount * 8 AS r2, (l_suppkey % 50) / 60.0::DOUBLE AS r3 FROM lineitem),
    q AS (SELECT quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM (SELECT unnest([r1, r2, r3]) AS r FROM s) WHERE r IS NOT NULL)
    SELECT l_orderkey, l_linenumber, {D.q6('list_avg([r1, r2, r3])')} AS control_mean, {D.q6('obs - list_avg([r1, r2, r3])')} AS delta, obs > hi AS shared, obs < lo AS inverted FROM s, q""")
def _(b):
    s = b.table("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("obs"), F.when(~(F.col("l_tax") > 0.07), F.col("l_tax") * 10).alias("r1"),
        (F.col("l_discount") * 8).alias("r2"), ((F.col("l_suppkey") % 50) / F.lit(60.0)).alias("r3"))
    out = gr.control_delta(s, "obs", ["r1", "r2", "r3"])
    return r6(out.select("l_orderkey", "l_linenumber", "control_mean", "delta", "shared", "inverted"), "control_mean", "delta")


# F. ranks

MODES = "l_returnflag, l_orderkey, l_linenumber"


@query("f1_rank_first", lambda: f"""
    SELECT {MODES}, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, md5(concat_ws('|', l_orderkey, l_linenumber)), l_orderkey, l_linenumber) AS rank FROM lineitem""")
def _(b):
    t = b.table("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return rk.rank(t, ["l_returnflag"], "l_quantity", ["l_orderkey", "l_linenumber"], "first").drop("l_quantity")


@query("f1_rank_average", lambda: f"""
    SELECT {MODES}, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem""")
def _(b):
    t = b.table("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return rk.rank(t, ["l_returnflag"], "l_quantity", [], "average").drop("l_quantity")


@query("f1_rank_pct", lambda: f"""
    SELECT c_custkey, {D.q6('(rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / count(*) OVER ()')} AS rank FROM customer""")
def _(b):
    return r6(rk.rank(b.table("customer").select("c_custkey", "c_acctbal"), [], "c_acctbal", [], "pct").drop("c_acctbal"), "rank")


@query("f2_quantile_bin", lambda: with_views("summary", """
    , r AS (SELECT target, state, guides, row_number() OVER (PARTITION BY state, guides IS NULL ORDER BY guides, md5(concat_ws('|', target)), target) AS r, count(guides) OVER (PARTITION BY state) AS n FROM summary)
    SELECT target, state, CASE WHEN guides IS NULL THEN -1 ELSE greatest(ceil((r - 1) * 5::DOUBLE / (n - 1)) - 1, 0) END::INT AS bin FROM r"""))
def _(b):
    s = b.view("summary").select("target", "state", F.col("guides").cast("double").alias("guides"))
    return rk.quantile_bin(s, "guides", 5, ["target"], ["state"]).select("target", "state", "bin")


@query("f3_median_bin", lambda: with_views("passed", """
    , m AS (SELECT *, quantile_cont(cells::DOUBLE, 0.5) OVER (PARTITION BY state) AS mc, quantile_cont(base_mean, 0.5) OVER (PARTITION BY state) AS mb FROM passed),
    u AS (SELECT target, 'states=' || string_agg(state, ',' ORDER BY state) || '|' || string_agg(state || ':cells:' || CASE WHEN cells <= mc THEN 'low' ELSE 'high' END || '|' || state || ':base_mean:' || CASE WHEN base_mean <= mb THEN 'low' ELSE 'high' END, '|' ORDER BY state) AS stratum FROM m GROUP BY target)
    SELECT target, stratum, count(*) OVER (PARTITION BY stratum) AS stratum_units, count(*) OVER (PARTITION BY stratum) >= 5 AS permutable FROM u"""))
def _(b):
    return rk.median_bin(b.view("passed"), "target", "state", ["cells", "base_mean"])


@query("f4_coarsen_strata", lambda: """
    WITH s AS (SELECT p_partkey, p_size // 10 AS coarse, concat_ws('|', p_size // 10, p_brand) AS fine FROM part),
    a AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY fine) < 14 THEN concat(coarse, '|all') ELSE fine END AS st FROM s)
    SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY st) < 14 THEN 'all' ELSE st END AS stratum FROM a""")
def _(b):
    s = b.table("part").select("p_partkey", F.floor(F.col("p_size") / 10).alias("coarse"), F.concat_ws("|", F.floor(F.col("p_size") / 10), "p_brand").alias("fine"))
    return rk.coarsen_strata(s, "fine", "coarse", 14).select("p_partkey", "stratum")


@query("f5_best_per_key", lambda: with_views("cis", f"""
    SELECT snp, gene, {D.q6('z')} AS z FROM cis QUALIFY row_number() OVER (PARTITION BY snp ORDER BY abs(z) DESC, gene) = 1"""))
def _(b):
    return r6(rk.best_per_key(b.view("cis"), ["snp"], [F.desc(F.abs("z")), F.asc("gene")], ["snp", "gene", "z"]), "z")


@query("f6_top_k_per_group", lambda: with_views("edges", f"""
    SELECT source, state, response, {D.q6('effect')} AS effect, position FROM (SELECT *, row_number() OVER (PARTITION BY source, state ORDER BY abs(effect) DESC, response) AS position FROM edges) WHERE position <= 5"""))
def _(b):
    t = rk.top_k_per_group(b.view("edges"), ["source", "state"], [F.desc(F.abs("effect")), F.asc("response")], 5)
    return r6(t.select("source", "state", "response", "effect", "position"), "effect")


@query("f7_zscore_within", lambda: with_views("passed", f"""
    SELECT target, state, {D.q6('effect / stddev_samp(effect) OVER (PARTITION BY state)')} AS scaled, {D.q6('(cells - avg(cells) OVER (PARTITION BY state)) / stddev_pop(cells) OVER (PARTITION BY state)')} AS standard FROM passed"""))
def _(b):
    z = rk.zscore_within(b.view("passed"), ["state"], "effect", 1, False, "scaled")
    return r6(rk.zscore_within(z, ["state"], "cells", 0, True, "standard").select("target", "state", "scaled", "standard"), "scaled", "standard")


@query("f8_demean_within", lambda: with_views("passed", f"""
    SELECT target, state, {D.q6('effect - avg(effect) OVER (PARTITION BY target)')} AS effect, {D.q6('cells - avg(cells) OVER (PARTITION BY target)')} AS cells FROM passed"""))
def _(b):
    return r6(rk.demean_within(b.view("passed").select("target", "state", "effect", "cells"), ["target"], ["effect", "cells"]), "effect", "cells")


@query("f9_tail_class", lambda: with_views("passed", """
    , q AS (SELECT quantile_cont(effect, 0.1) AS lo, quantile_cont(effect, 0.9) AS hi FROM passed)
    SELECT target, state, CASE WHEN effect <= lo THEN 'buffered' WHEN effect >= hi THEN 'amplified' ELSE 'intermediate' END AS tail_class FROM passed, q"""))
def _(b):
    return rk.tail_class(b.view("passed").select("target", "state", "effect"), "effect").select("target", "state", "tail_class")


@query("f10_heldout_tail", lambda: with_views("passed", f"""
    , w AS (SELECT target, max(effect) FILTER (WHERE state = 'A') AS a, max(effect) FILTER (WHERE state = 'N') AS n, max(effect) FILTER (WHERE state = 'R') AS r FROM passed GROUP BY target HAVING count(*) = 3),
    l AS (SELECT target, 'A' AS heldout_state, (n + r) / 2 AS training, a AS heldout FROM w UNION ALL SELECT target, 'N', (a + r) / 2, n FROM w UNION ALL SELECT target, 'R', (a + n) / 2, r FROM w),
    c AS (SELECT *, quantile_cont(training, 0.1) OVER (PARTITION BY heldout_state) AS cut FROM l)
    SELECT target, heldout_state, {D.q6('training')} AS training, {D.q6('heldout')} AS heldout, {D.q6('cut')} AS cut FROM c WHERE training <= cut"""))
def _(b):
    return r6(rk.heldout_tail(b.view("passed"), "target", "state", STATES, "effect"), "training", "heldout", "cut")


@query("f11_lag_pairs", lambda: """
    SELECT user_id, event_id, value, nxt AS value_next FROM (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL""")
def _(b):
    return rk.lag_pairs(b.table("events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").drop("ts")


@query("f12_rank_by_order", lambda: with_views("summary", """
    , u AS (SELECT target, max(effect) > 0.02 AS amplified, min(effect) < -0.02 AS buffered, max(effect) - min(effect) < 0.01 AS stable, max(effect) - min(effect) > 0.03 AS rerouted, sum(cells) AS cells, max(guides) AS guides FROM summary GROUP BY target),
    p1 AS (SELECT 1 AS pick, 'amplified' AS class, target FROM u WHERE amplified ORDER BY guides DESC NULLS LAST, cells DESC, target LIMIT 1),
    p2 AS (SELECT 2, 'buffered', target FROM u WHERE buffered AND target NOT IN (SELECT target FROM p1) ORDER BY guides DESC NULLS LAST, cells DESC, target LIMIT 1),
    p3 AS (SELECT 3, 'stable', target FROM u WHERE stable AND target NOT IN (SELECT target FROM p1 UNION ALL SELECT target FROM p2) ORDER BY guides DESC NULLS LAST, cells DESC, target LIMIT 1),
    p4 AS (SELECT 4, 'rerouted', target FROM u WHERE rerouted AND target NOT IN (SELECT target FROM p1 UNION ALL SELECT target FROM p2 UNION ALL SELECT target FROM p3) ORDER BY guides DESC NULLS LAST, cells DESC, target LIMIT 1)
    SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4"""))
def _(b):
    u = b.view("summary").groupBy("target").agg(
        (F.max("effect") > 0.02).alias("amplified"), (F.min("effect") < -0.02).alias("buffered"), (F.max("effect") - F.min("effect") < 0.01).alias("stable"),
        (F.max("effect") - F.min("effect") > 0.03).alias("rerouted"), F.sum("cells").alias("cells"), F.max("guides").alias("guides"))
    return rk.rank_by_order(u, "target", ["amplified", "buffered", "stable", "rerouted"], {"guides": False, "cells": False})
