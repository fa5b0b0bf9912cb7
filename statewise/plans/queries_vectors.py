"""Vector, module and dynamics queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statewise.operators import dynamics as dy
from statewise.operators import vectors as vx
from statewise.plans.bindings import DUCK, q6
from statewise.plans.queries_groups import r6
from statewise.plans.queries_resample import shuffled
from statewise.plans.registry import query, with_views
from statewise.session import cut_lineage, written

D = DUCK
STATES = ("A", "N", "R")


def _rows(b):
    return b.table("supplier").select(
        F.col("s_suppkey").alias("target"), F.explode(F.array(*[F.lit(s) for s in STATES])).alias("state"),
        F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("F"), F.col("s_suppkey") % 40)).alias("own_feature"),
        F.concat(F.lit("F"), (F.col("s_suppkey") + 1) % 40).alias("fallback_feature"), (F.col("s_acctbal") / 10000).alias("cis"))


@query("i1_build_response", lambda: with_views("tests", f"""
    SELECT target, state, feature, {D.q6('effect / greatest(abs(s_acctbal / 10000), 0.1)')} AS value FROM tests JOIN supplier ON s_suppkey = target
    WHERE adj_p <= 0.02 AND effect <> 0 AND feature <> concat('F', (target + 1) % 40) AND (target % 5 = 0 OR feature <> concat('F', target % 40))"""))
def _(b):
    return r6(vx.build_response(b.view("tests"), _rows(b), ["target", "state"], 0.02), "value")


@query("i2_response_metrics", lambda: with_views("tests", f"""
    , t AS (SELECT target, state, effect AS e, adj_p / 4 AS se, adj_p <= 0.02 AS sig, CASE WHEN adj_p <= 0.02 THEN effect ELSE 0 END AS s, greatest(s_acctbal / 10000, 0.1) AS sc FROM tests JOIN supplier ON s_suppkey = target),
    m AS (SELECT target, state, max(sc) AS sc, sqrt(sum(e * e)) AS l2_naive, sqrt(sum(greatest(e * e - se * se, 0))) AS l2_debiased, sqrt(sum(s * s)) AS l2_significant, sum(abs(s)) AS l1_significant, count(*) FILTER (WHERE sig AND e > 0) AS positive,
      count(*) FILTER (WHERE sig AND e < 0) AS negative, count(*) FILTER (WHERE sig) AS size, sum(s) AS signed_sum FROM t GROUP BY target, state)
    SELECT target, state, {', '.join(D.q6(c) + ' AS ' + c for c in ('l2_naive', 'l2_debiased', 'l2_significant', 'l1_significant', 'signed_sum'))}, positive, negative, size, {D.q6('l2_debiased / sc')} AS gain_l2_debiased,
      {D.q6('l2_significant / sc')} AS gain_l2_significant, {D.q6('l1_significant / sc')} AS gain_l1_significant, {D.q6('CASE WHEN l2_significant > 0 THEN pow(l1_significant, 2) / pow(l2_significant, 2) ELSE 0 END')} AS effective_dimension,
      {D.q6('(positive - negative)::DOUBLE / greatest(size, 1)')} AS sign_balance FROM m"""))
def _(b):
    t = b.view("tests").withColumn("se", F.col("adj_p") / 4).join(b.table("supplier").select(F.col("s_suppkey").alias("target"), "s_acctbal"), "target")
    out = vx.response_metrics(t, ["target", "state"], F.greatest(F.col("s_acctbal") / 10000, F.lit(0.1)), 0.02)
    return r6(out, *[c for c in out.columns if c not in ("target", "state", "positive", "negative", "size")])


COS = """, d AS (SELECT a.target, a.state AS l, z.state AS r, sum(a.value * z.value) AS dot FROM effects a JOIN effects z ON a.target = z.target AND a.feature = z.feature GROUP BY ALL), u AS (SELECT DISTINCT target FROM effects),
    n AS (SELECT target, s, coalesce((SELECT sqrt(dot) FROM d WHERE d.target = u.target AND l = s AND r = s), 0) AS nm FROM u, (VALUES ('A'), ('N'), ('R')) v(s)),
    p AS (SELECT a.target, a.s AS left_state, z.s AS right_state, a.nm AS left_norm, z.nm AS right_norm, coalesce(dot / nullif(a.nm * z.nm, 0), 0) AS cosine FROM n a JOIN n z ON a.target = z.target AND a.s < z.s LEFT JOIN d ON d.target = a.target AND l = a.s AND r = z.s)"""


@query("i3_row_cosine", lambda: with_views("effects", COS + f" SELECT target, left_state, right_state, {D.q6('left_norm')} AS left_norm, {D.q6('right_norm')} AS right_norm, {D.q6('cosine')} AS cosine FROM p"))
def _(b):
    return r6(vx.row_cosine(b.view("effects"), ["target"], STATES), "left_norm", "right_norm", "cosine")


@query("i4_fit_modules")
def _(b):
    e = b.view("effects")
    loadings, _ = dy.fit_modules(e, ["target", "state"], 6)
    return dy.explained_variance(e, dy.project(e, loadings, ["target", "state"]), ["target", "state"])


@query("i5_cross_fitted_modules")
def _(b):
    e = b.view("effects").withColumn("fold", (F.col("target") % 3).cast("int"))
    return dy.cross_fitted_modules(e, ["target", "state"], "fold", 3, 6)[0]


ENERGY = ", e AS (SELECT target, state, module, score, CASE WHEN sum(score * score) OVER w > 0 THEN score * score / sum(score * score) OVER w ELSE 0 END AS energy FROM tensor WINDOW w AS (PARTITION BY target, state))"


@query("i6_module_energy", lambda: with_views("tensor", ENERGY + f" SELECT target, state, module, {D.q6('score')} AS score, {D.q6('energy')} AS energy FROM e"))
def _(b):
    return r6(vx.module_energy(b.view("tensor"), ["target", "state"]), "score", "energy")


@query("i6_dominant_module", lambda: with_views("tensor", ENERGY + f" SELECT target, state, module AS dominant_module, {D.q6('energy')} AS dominant_fraction FROM e QUALIFY row_number() OVER (PARTITION BY target, state ORDER BY energy DESC, module) = 1"))
def _(b):
    return r6(vx.dominant_module(vx.module_energy(b.view("tensor"), ["target", "state"]), ["target", "state"]), "dominant_fraction")


JS = ENERGY + """, c AS (SELECT a.target, a.state AS left_state, z.state AS right_state, a.energy / nullif(sum(a.energy) OVER w, 0) AS p, z.energy / nullif(sum(z.energy) OVER w, 0) AS q FROM e a JOIN e z ON a.target = z.target AND a.module = z.module AND a.state < z.state
      WINDOW w AS (PARTITION BY a.target, a.state, z.state)),
    j AS (SELECT target, left_state, right_state, CASE WHEN count(p) > 0 AND count(q) > 0 THEN sum(0.5 * (CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END)) END AS js FROM c GROUP BY ALL)"""


@query("i7_js_divergence", lambda: with_views("tensor", JS + f" SELECT target, left_state, right_state, {D.q6('least(greatest(js / ln(2), 0), 1)')} AS js FROM j"))
def _(b):
    return r6(vx.js_divergence(vx.module_energy(b.view("tensor"), ["target", "state"]), ["target"], STATES), "js")


@query("i7_js_divergence_natural", lambda: with_views("tensor", JS + f" SELECT target, left_state, right_state, {D.q6('js')} AS js FROM j"))
def _(b):
    return r6(vx.js_divergence(vx.module_energy(b.view("tensor"), ["target", "state"]), ["target"], STATES, base=None), "js")


@query("i8_gain_ratio", lambda: with_views("effects", COS + f" SELECT target, left_state, right_state, left_norm > 0 AND right_norm > 0 AS evaluable, {D.q6('CASE WHEN left_norm > 0 AND right_norm > 0 THEN abs(log2(right_norm / left_norm)) END')} AS gain_ratio FROM p"))
def _(b):
    g = vx.gain_ratio(vx.row_cosine(b.view("effects"), ["target"], STATES))
    return r6(g.select("target", "left_state", "right_state", "evaluable", "gain_ratio"), "gain_ratio")


DELTA = 1 / 1800
ZERO = ENERGY + f""", zr AS (SELECT *, sum(energy) OVER w AS t, sum((energy = 0)::INT) OVER w AS zeros FROM e WINDOW w AS (PARTITION BY target, state)), rp AS (SELECT *, CASE WHEN t <= 0 THEN 'empty_composition' ELSE 'replaced' END AS status,
      CASE WHEN t <= 0 THEN NULL WHEN energy = 0 THEN {DELTA!r}::DOUBLE ELSE energy / t * (1 - zeros * {DELTA!r}::DOUBLE) END AS replaced FROM zr)"""


@query("i9_zero_replace", lambda: with_views("tensor", ZERO + f" SELECT target, state, module, zeros::BIGINT AS zeros, status, {D.q6('replaced')} AS replaced FROM rp"))
def _(b):
    z = vx.zero_replace(vx.module_energy(b.view("tensor"), ["target", "state"]), ["target", "state"])
    return r6(z.select("target", "state", "module", "zeros", "status", "replaced"), "replaced")


@query("i10_aitchison", lambda: with_views("tensor", ZERO + f""", k AS (SELECT target, state, module, ln(replaced) - avg(ln(replaced)) OVER (PARTITION BY target, state) AS clr, count(*) OVER (PARTITION BY target, state) AS parts FROM rp)
    SELECT a.target, a.state AS left_state, z.state AS right_state, {D.q6('sqrt(sum(pow(a.clr - z.clr, 2)) / count(*))')} AS aitchison, count(*) AS parts FROM k a JOIN k z ON a.target = z.target AND a.module = z.module AND a.state < z.state AND a.parts = 8 AND z.parts = 8 GROUP BY ALL"""))
def _(b):
    z = vx.zero_replace(vx.module_energy(b.view("tensor"), ["target", "state"]), ["target", "state"])
    return r6(vx.aitchison(z, ["target"], STATES).filter("parts = 8"), "aitchison")


WIDE = """, w AS (SELECT target, feature, coalesce(sum(value) FILTER (WHERE state = 'A'), 0) AS a, coalesce(sum(value) FILTER (WHERE state = 'N'), 0) AS n, coalesce(sum(value) FILTER (WHERE state = 'R'), 0) AS r FROM effects GROUP BY target, feature),
    c AS (SELECT *, (a + n + r) / 3 AS co, greatest(least(a, n, r), 0) + least(greatest(a, n, r), 0) AS cs FROM w)"""


@query("i11_decompose_states", lambda: with_views("effects", WIDE + f""", m AS (SELECT target, sum(a * a) AS ea, sum(n * n) AS en, sum(r * r) AS er, 3 * sum(co * co) AS ce, sum(pow(a - co, 2)) AS ra, sum(pow(n - co, 2)) AS rn, sum(pow(r - co, 2)) AS rr, 2 * sum(co * (a - co)) AS xa,
      2 * sum(co * (n - co)) AS xn, 2 * sum(co * (r - co)) AS xr, 3 * sum(cs * cs) AS cse, count(*) FILTER (WHERE cs <> 0) AS consensus_features, count(*) AS union_features FROM c GROUP BY target)
    SELECT target, {D.q6('ea')} AS "energy_A", {D.q6('en')} AS "energy_N", {D.q6('er')} AS "energy_R", {D.q6('ce')} AS core_energy, {D.q6('ra')} AS "residual_A", {D.q6('rn')} AS "residual_N", {D.q6('rr')} AS "residual_R", {D.q6('xa')} AS "cross_A", {D.q6('xn')} AS "cross_N", {D.q6('xr')} AS "cross_R",
      consensus_features, union_features, {D.q6('ea + en + er')} AS total_energy, {D.q6('ra + rn + rr')} AS residual_energy, {D.q6('ce / (ea + en + er)')} AS core_fraction, {D.q6('cse / (ea + en + er)')} AS consensus_energy_fraction,
      {D.q6('consensus_features::DOUBLE / union_features')} AS consensus_feature_fraction, {D.q6('1 - ce / (ea + en + er)')} AS residual_fraction FROM m"""))
def _(b):
    out = vx.decompose_states(b.view("effects"), ["target"], STATES)
    return r6(out, *[c for c in out.columns if c not in ("target", "consensus_features", "union_features")])


def _lso(s, x, o1, o2):
    p = f"({o1} + {o2}) / 2"
    return (f"SELECT target, '{s}' AS heldout_state, {D.q6(f'sum(pow({p}, 2))')} AS prediction_energy, {D.q6(f'sum({x} * {x})')} AS heldout_energy, {D.q6(f'sum({p} * {x}) / nullif(sqrt(sum(pow({p}, 2)) * sum({x} * {x})), 0)')} AS cosine, "
            f"{D.q6(f'sum(pow({x} - {p}, 2)) / nullif(sum({x} * {x}), 0)')} AS relative_error FROM w GROUP BY target")


@query("i12_leave_one_state_prediction", lambda: with_views("effects", WIDE + " " + " UNION ALL ".join([_lso("A", "a", "n", "r"), _lso("N", "n", "a", "r"), _lso("R", "r", "a", "n")])))
def _(b):
    return r6(vx.leave_one_state_prediction(b.view("effects"), ["target"], STATES), "prediction_energy", "heldout_energy", "cosine", "relative_error")


def _core_null():
    maps = []
    for i in (1, 2):
        text = shuffled("su", "stratum", "target", "donor", 40 + i, 10)
        for name in ("b0", "dn", "sh"):
            text = text.replace(f"{name} AS (", f"{name}{i} AS (").replace(f"{name}.", f"{name}{i}.").replace(f"FROM {name}", f"FROM {name}{i}").replace(f"JOIN {name} ", f"JOIN {name}{i} ")
        maps.append(text)
    return with_views("effects", f""", su AS (SELECT target, target % 4 AS stratum, target AS donor FROM (SELECT DISTINCT target FROM effects)), {', '.join(maps)},
      st AS (SELECT r AS replicate, target, feature, value FROM effects, range(10) z(r) WHERE state = 'A' UNION ALL SELECT replicate, sh1.target, feature, value FROM sh1 JOIN effects e ON e.target = donor AND state = 'N'
        UNION ALL SELECT replicate, sh2.target, feature, value FROM sh2 JOIN effects e ON e.target = donor AND state = 'R'),
      ce AS (SELECT replicate, target, feature, sum(value) AS s, sum(value * value) AS e FROM st GROUP BY ALL), f AS (SELECT replicate, target, sum(s * s) / 3 / sum(e) AS f FROM ce GROUP BY ALL)
      SELECT replicate, {D.q6('avg(f)')} AS mean_core_fraction, count(*) AS units FROM f GROUP BY replicate""")


@query("i13_core_permutation_null", _core_null)
def _(b):
    e = b.view("effects")
    strata = e.select("target").distinct().withColumn("stratum", F.col("target") % 4)
    return r6(vx.core_permutation_null(e, strata, "target", "stratum", STATES, 10, 40), "mean_core_fraction")


SETS = "st AS (SELECT DISTINCT p_type AS set_id, concat('F', p_partkey % 40) AS member FROM part)"


def _sets(b):
    return b.table("part").select(F.col("p_type").alias("set_id"), F.concat(F.lit("F"), F.col("p_partkey") % 40).alias("member")).distinct()


@query("i14_set_activity", lambda: with_views("effects", f""", {SETS}, z AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS k FROM st)
    SELECT target, state, set_id, {D.q6('sum(value) / max(k)')} AS activity FROM effects JOIN z ON member = feature GROUP BY target, state, set_id"""))
def _(b):
    return r6(vx.set_activity(b.view("effects"), _sets(b), ["target", "state"]), "activity")


@query("i14_activity_range", lambda: with_views("effects", f""", {SETS}, z AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS k FROM st), a AS (SELECT target, state, set_id, sum(value) / max(k) AS v FROM effects JOIN z ON member = feature GROUP BY ALL),
    r AS (SELECT target, set_id, CASE WHEN count(*) < 3 THEN greatest(max(v), 0) - least(min(v), 0) ELSE max(v) - min(v) END AS rg FROM a GROUP BY ALL)
    SELECT target, {D.q6('max(rg)')} AS "range" FROM r GROUP BY target"""))
def _(b):
    out = vx.activity_range(vx.set_activity(b.view("effects"), _sets(b), ["target", "state"]), "target", 3)
    return r6(out.select("target", "range"), "range")


NET = "nw AS (SELECT p_brand AS factor, concat('F', p_partkey % 40) AS feature, CASE WHEN min(p_size) < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight FROM part GROUP BY ALL)"


@query("i15_factor_activity", lambda: with_views("effects", f""", {NET}, fa AS (SELECT factor, count(*) AS targets, sum(weight) AS ws, sum(weight * weight) AS ww FROM nw GROUP BY factor HAVING count(*) >= 5),
    rw AS (SELECT target, state, sum(value) AS xs, sum(value * value) AS xx FROM effects GROUP BY ALL), ra AS (SELECT target, state, factor, sum(value * weight) AS raw FROM effects JOIN nw USING (feature) GROUP BY ALL),
    s AS (SELECT rw.target, rw.state, factor, targets, coalesce(raw, 0) / greatest(ww, 1) AS wm, least(greatest((coalesce(raw, 0) - xs * ws / 40) / sqrt(greatest((xx - xs * xs / 40) * (ww - ws * ws / 40), 1e-24)), -1 + 1e-12), 1 - 1e-12) AS r FROM rw CROSS JOIN fa LEFT JOIN ra USING (target, state, factor)),
    u AS (SELECT *, r * sqrt(38 / greatest(1 - r * r, 1e-24)) AS ulm FROM s)
    SELECT target, state, factor, targets, {D.q6('wm')} AS weighted_mean, {D.q6('ulm')} AS ulm, {D.q6('((wm - avg(wm) OVER w) / stddev_pop(wm) OVER w + (ulm - avg(ulm) OVER w) / stddev_pop(ulm) OVER w) / 2')} AS consensus FROM u WINDOW w AS (PARTITION BY factor)"""))
def _(b):
    net = b.table("part").groupBy(F.col("p_brand").alias("factor"), F.concat(F.lit("F"), F.col("p_partkey") % 40).alias("feature")).agg(F.when(F.min("p_size") < 8, 1.0).otherwise(-1.0).alias("weight"))
    return r6(vx.factor_activity(b.view("effects"), net, ["target", "state"], 40), "weighted_mean", "ulm", "consensus")


GRID = """, fs AS (SELECT DISTINCT feature FROM series), ss AS (SELECT DISTINCT step FROM series), g AS (SELECT step, feature, coalesce(x, 0) AS x FROM ss CROSS JOIN fs LEFT JOIN series USING (step, feature)),
    l AS (SELECT *, lead(x) OVER (PARTITION BY feature ORDER BY step) AS y FROM g), q AS (SELECT * FROM l WHERE y IS NOT NULL)"""


@query("i16_correlation_edges", lambda: with_views("series", GRID + f" SELECT a.feature AS regulator, z.feature AS gene, {D.q6('abs(corr(a.x, z.x))')} AS score FROM g a JOIN g z ON a.step = z.step AND a.feature <> z.feature GROUP BY ALL"))
def _(b):
    return r6(dy.correlation_edges(b.view("series"), ["step"]), "score")


@query("i17_lagged_correlation", lambda: with_views("series", GRID + f" SELECT a.feature AS regulator, z.feature AS gene, {D.q6('abs(corr(a.x, z.y))')} AS score FROM q a JOIN q z ON a.step = z.step AND a.feature <> z.feature GROUP BY ALL"))
def _(b):
    return r6(dy.lagged_correlation(b.view("series"), "step"), "score")


@query("i18_transition_edges")
def _(b):
    return dy.transition_edges(b.view("series"), "step", 10.0)


@query("i18_transition_optimality", lambda: with_views("series", " SELECT DISTINCT feature AS target, TRUE AS optimal, TRUE AS solved FROM series"))
def _(b):
    """Gradient of the penalised loss of every output, from sums over the rows, and the solver's own residual."""
    long, alpha = b.view("series"), 10.0
    op = cut_lineage(dy.transition_operator(long, "step", alpha))
    steps, features = long.select("step").distinct(), long.select("feature").distinct()
    full = cut_lineage(steps.join(features).join(long, ["step", "feature"], "left").select("step", "feature", F.coalesce("x", F.lit(0.0)).alias("x")))
    following = Window.partitionBy("feature").orderBy("step")
    pairs = full.withColumn("y", F.lead("x").over(following)).filter("y IS NOT NULL")
    centre = lambda c: (F.col(c) - F.avg(c).over(Window.partitionBy("feature"))).alias(c)
    pairs = cut_lineage(pairs.select("step", "feature", centre("x"), centre("y")))
    fitted = pairs.join(op, pairs["feature"] == op["source"]).groupBy("step", "target").agg(F.sum(F.col("x") * F.col("weight")).alias("fit"))
    off = fitted.join(pairs.select("step", F.col("feature").alias("target"), "y"), ["step", "target"]).select("step", "target", "y", (F.col("y") - F.col("fit")).alias("off"))
    slope = pairs.select("step", F.col("feature").alias("source"), "x").join(off, "step").groupBy("source", "target").agg(F.sum(F.col("x") * F.col("off")).alias("g"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    both = slope.join(op, ["source", "target"]).groupBy("target").agg(F.max(F.abs(F.col("g") - alpha * F.col("weight"))).alias("worst"), F.max(F.abs("xy")).alias("scale"), F.max("residual").alias("residual"))
    return both.select("target", (F.col("worst") <= 1e-7 * F.greatest("scale", F.lit(1.0))).alias("optimal"), (F.col("residual") <= 1e-9).alias("solved"))


@query("i19_finite_horizon")
def _(b):
    return dy.horizon_edges(dy.transition_horizon(b.view("series"), "step", 10.0, 3))


@query("i19_depth_growth")
def _(b):
    return dy.depth_growth(dy.transition_horizon(b.view("series"), "step", 10.0, 3), 3)


# Rows of this operator add up to 1, so its radius is 1 and the stabilised operator is 0.95 of it.
CHAIN = """WITH ct AS (SELECT l_partkey % 60 AS source, (CAST(l_quantity AS BIGINT) * 3 + l_suppkey) % 60 AS target, count(*) AS n FROM lineitem GROUP BY ALL),
    w AS (SELECT source, target, 0.95 * n / sum(n) OVER (PARTITION BY source) AS weight FROM ct),
    p2 AS (SELECT a.source, z.target, sum(a.weight * z.weight) AS weight FROM w a JOIN w z ON a.target = z.source GROUP BY ALL), p3 AS (SELECT a.source, z.target, sum(a.weight * z.weight) AS weight FROM w a JOIN p2 z ON a.target = z.source GROUP BY ALL)"""


def _chain(b):
    n = b.table("lineitem").groupBy((F.col("l_partkey") % 60).alias("source"), ((F.col("l_quantity").cast("bigint") * 3 + F.col("l_suppkey")) % 60).alias("target")).count()
    return n.select("source", "target", (F.col("count") / F.sum("count").over(Window.partitionBy("source"))).alias("weight"))


@query("i19_chain_powers", lambda: CHAIN + f" SELECT source, target, depth, {D.q6('weight')} AS weight FROM (SELECT *, 1 AS depth FROM w UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3)")
def _(b):
    return r6(dy.finite_horizon(_chain(b), 3, 0.95), "weight")


BROUGHT = "b AS (SELECT p_partkey % 70 AS node, p_size % 4 AS input, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY ALL)"


@query("i19_input_map", lambda: CHAIN + f""", {BROUGHT}, k1 AS (SELECT w.source AS node, input, sum(weight * value) AS value FROM w JOIN b ON node = target GROUP BY ALL), k2 AS (SELECT w.source AS node, input, sum(weight * value) AS value FROM w JOIN k1 ON node = target GROUP BY ALL),
    k3 AS (SELECT w.source AS node, input, sum(weight * value) AS value FROM w JOIN k2 ON node = target GROUP BY ALL), a AS (SELECT * FROM b UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)
    SELECT node, input, {D.q6('sum(value)')} AS weight FROM a GROUP BY node, input""")
def _(b):
    brought = b.table("part").groupBy((F.col("p_partkey") % 70).alias("node"), (F.col("p_size") % 4).alias("input")).agg(F.count("*").cast("double").alias("value"))
    return r6(dy.horizon_edges(dy.finite_horizon(_chain(b), 3, 0.95, inputs=brought)), "weight")


@query("i19_stability", lambda: "SELECT 1.0::DOUBLE AS radius, FALSE AS stable, TRUE AS converged, TRUE AS condition_converged")
def _(b):
    """Radius of the whole operator; the condition number of I - W is unbounded here and that of I - W/2 is tested apart."""
    out = dy.spectral_radius(_chain(b), condition=True)
    return r6(out.select("radius", "stable", "converged", "condition_converged"), "radius")


@query("i20_propagate", lambda: with_views("edges", f""", ed AS (SELECT source, response % 100 AS target, 1.0::DOUBLE AS weight FROM edges WHERE direction = 1 GROUP BY ALL), x AS (SELECT s_suppkey AS node, 'c1' AS "column", s_acctbal AS value FROM supplier),
    n AS (SELECT node FROM x UNION SELECT source FROM ed UNION SELECT target FROM ed), au AS (SELECT source, target, weight FROM ed UNION ALL SELECT node, node, 1.0 FROM n), dg AS (SELECT source, greatest(sum(weight), 1e-12) AS d FROM au GROUP BY source),
    w AS (SELECT a.source, a.target, a.weight / sqrt(p.d * q.d) AS w FROM au a JOIN dg p ON p.source = a.source JOIN dg q ON q.source = a.target), h1 AS (SELECT w.source AS node, "column", sum(w * value) AS value FROM w JOIN x ON x.node = target GROUP BY ALL),
    h2 AS (SELECT w.source AS node, "column", sum(w * value) AS value FROM w JOIN h1 ON h1.node = target GROUP BY ALL)
    SELECT node, "column", {D.q6('value')} AS value, 0 AS hop FROM x UNION ALL SELECT node, "column", {D.q6('value')}, 1 FROM h1 UNION ALL SELECT node, "column", {D.q6('value')}, 2 FROM h2"""))
def _(b):
    ed = b.view("edges").filter("direction = 1").select("source", (F.col("response") % 100).alias("target")).distinct().withColumn("weight", F.lit(1.0))
    x = b.table("supplier").select(F.col("s_suppkey").alias("node"), F.lit("c1").alias("column"), F.col("s_acctbal").alias("value"))
    return r6(vx.propagate(x, ed), "value")


KNN = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id AS s, z.vec_id AS t, sqrt(list_sum(list_transform(list_zip(a.e, z.e), lambda x: pow(x[1] - x[2], 2)))) AS dist, z.label AS y FROM v a JOIN v z ON {cond}),
    k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY dist, t) AS slot FROM d)"""


@query("i21_knn_graph", lambda: KNN.format(cond="a.vec_id <> z.vec_id") + f" SELECT s AS source, t AS target, {D.q6('dist')} AS distance, slot FROM k WHERE slot <= 5")
def _(b):
    g = vx.knn_graph(b.table("embeddings"), "vec_id", "embedding", 5)
    return r6(g, "distance")


@query("i21_knn_regression", lambda: KNN.format(cond="a.vec_id % 4 = 0 AND z.vec_id % 4 <> 0") + f" SELECT s AS vec_id, {D.q6('CASE WHEN min(dist) = 0 THEN avg(y) FILTER (WHERE dist = 0) ELSE sum(y / dist) / sum(1 / dist) END')} AS prediction, {D.q6('avg(y)')} AS neighbor_mean FROM k WHERE slot <= 15 GROUP BY s")
def _(b):
    e = b.table("embeddings")
    return r6(vx.knn_regression(e.filter("vec_id % 4 <> 0"), e.filter("vec_id % 4 = 0"), "vec_id", "embedding", "label", 15), "prediction", "neighbor_mean")


@query("i22_remove_nuisance")
def _(b):
    e = b.view("effects").groupBy("target", "feature").agg(F.avg("value").alias("value"))
    cov = b.table("supplier").select(F.col("s_suppkey").alias("target"), "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"))
    return dy.remove_nuisance(e, cov, "target", ["s_acctbal", "s_nationkey"])


DEC = """, qv AS (SELECT target, feature, value FROM effects WHERE state = 'R'), ct AS (SELECT target, feature, sum(value) / 2 AS value FROM effects WHERE state <> 'R' GROUP BY ALL), qn AS (SELECT target, sqrt(sum(value * value)) AS n FROM qv GROUP BY 1), cn AS (SELECT target, sqrt(sum(value * value)) AS n FROM ct GROUP BY 1),
    dt AS (SELECT qv.target AS u, ct.target AS c, sum(qv.value * ct.value) AS dot FROM qv JOIN ct USING (feature) GROUP BY ALL), s AS (SELECT qn.target AS u, cn.target AS c, coalesce(dot, 0) / (qn.n * cn.n) AS s FROM qn CROSS JOIN cn LEFT JOIN dt ON dt.u = qn.target AND dt.c = cn.target),
    z AS (SELECT u, beta, count(*) AS classes, ln(sum(exp(beta * s))) AS lz, max(s) FILTER (WHERE u = c) AS ts, max(s) AS top FROM s, (VALUES (1.0::DOUBLE), (5.0::DOUBLE), (20.0::DOUBLE)) v(beta) GROUP BY u, beta)"""


@query("i23_decode_states", lambda: with_views("effects", DEC + f" SELECT u AS target, beta, classes, {D.q6('ts')} AS true_score, {D.q6('beta * ts - lz')} AS log_probability, {D.q6('ln(classes) + beta * ts - lz')} AS information, CASE WHEN ts >= top - 1e-14 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fractional_top1 FROM z"))
def _(b):
    return r6(_decoded(b), "true_score", "log_probability", "information")


def _decoded(b):
    e = cut_lineage(b.view("effects"))
    centroids = e.filter("state <> 'R'").groupBy("target", "feature").agg((F.sum("value") / 2).alias("value"))
    return vx.decode_states(e.filter("state = 'R'").select("target", "feature", "value"), centroids, "target", [1.0, 5.0, 20.0])


@query("i23_choose_beta", lambda: with_views("effects", DEC + f" SELECT beta, {D.q6('avg(lz - beta * ts)')} AS log_loss FROM z GROUP BY beta ORDER BY avg(lz - beta * ts), beta LIMIT 1"))
def _(b):
    return r6(vx.choose_beta(_decoded(b)), "log_loss")


# Targets without a response in a state are zero vectors there; all suppliers are units.
NEST = """, e5 AS (SELECT * FROM effects WHERE (target + ascii(state)) % 5 <> 0), us AS (SELECT s_suppkey AS u FROM supplier), st AS (SELECT unnest(['A', 'N', 'R']) AS s),
    iv AS (SELECT h.s AS h, t.s AS t, v.s AS v FROM st h, st t, st v WHERE h.s <> t.s AND h.s <> v.s AND t.s <> v.s), nr AS (SELECT state, target, sqrt(sum(value * value)) AS n FROM e5 GROUP BY ALL),
    dt AS (SELECT q.state AS v, c.state AS t, q.target AS u, c.target AS c, sum(q.value * c.value) AS dot FROM e5 q JOIN e5 c ON q.feature = c.feature AND q.state <> c.state GROUP BY ALL),
    sc AS (SELECT h, iv.t, iv.v, us.u, c.u AS c, coalesce(dot / nullif(nq.n * nc.n, 0), 0) AS s FROM iv, us, us c LEFT JOIN dt ON dt.v = iv.v AND dt.t = iv.t AND dt.u = us.u AND dt.c = c.u LEFT JOIN nr nq ON nq.state = iv.v AND nq.target = us.u LEFT JOIN nr nc ON nc.state = iv.t AND nc.target = c.u),
    lz AS (SELECT h, t, v, u, beta, ln(sum(exp(beta * s))) - beta * max(s) FILTER (WHERE u = c) AS loss FROM sc, (VALUES (1.0::DOUBLE), (5.0::DOUBLE), (20.0::DOUBLE)) b(beta) GROUP BY h, t, v, u, beta),
    il AS (SELECT h AS heldout_state, t AS inner_training_state, v AS inner_validation_state, beta, avg(loss) AS log_loss, count(*) AS targets FROM lz GROUP BY ALL)"""


def _nested(b):
    e = written(b.view("effects"), "effects").filter((F.col("target") + F.ascii("state")) % 5 != 0)
    return vx.nested_decode(e, "target", "state", STATES, [1.0, 5.0, 20.0], b.table("supplier").select(F.col("s_suppkey").alias("target")))


@query("i23_inner_losses", lambda: with_views("effects", NEST + f" SELECT heldout_state, inner_training_state, inner_validation_state, beta, targets, {D.q6('log_loss')} AS log_loss FROM il"))
def _(b):
    return r6(_nested(b)[0], "log_loss")


@query("i23_nested_decode", lambda: with_views("effects", NEST + f""", ch AS (SELECT heldout_state AS h, beta FROM (SELECT heldout_state, beta, row_number() OVER (PARTITION BY heldout_state ORDER BY avg(log_loss), beta) AS r FROM il GROUP BY heldout_state, beta) WHERE r = 1),
    ct AS (SELECT s AS h, target, feature, sum(value) / 2 AS value FROM st JOIN e5 ON s <> state GROUP BY ALL), cn AS (SELECT h, target, sqrt(sum(value * value)) AS n FROM ct GROUP BY ALL), od AS (SELECT ct.h, q.target AS u, ct.target AS c, sum(q.value * ct.value) AS dot FROM e5 q JOIN ct ON q.state = ct.h AND q.feature = ct.feature GROUP BY ALL),
    os AS (SELECT ch.h, beta, us.u, c.u AS c, coalesce(dot / nullif(nq.n * nc.n, 0), 0) AS s FROM ch, us, us c LEFT JOIN od ON od.h = ch.h AND od.u = us.u AND od.c = c.u LEFT JOIN nr nq ON nq.state = ch.h AND nq.target = us.u LEFT JOIN cn nc ON nc.h = ch.h AND nc.target = c.u),
    z AS (SELECT h, beta, u, count(*) AS classes, max(s) AS top, max(s) FILTER (WHERE u = c) AS ts, ln(sum(exp(beta * s))) AS lz FROM os GROUP BY h, beta, u), tt AS (SELECT z.h, z.u, count(*) AS ties FROM z JOIN os ON z.h = os.h AND z.u = os.u AND s >= top - 1e-14 GROUP BY ALL)
    SELECT h AS heldout_state, u AS target, beta, classes, {D.q6('ts')} AS true_score, {D.q6('beta * ts - lz')} AS log_probability, {D.q6('ln(classes) + beta * ts - lz')} AS information, CASE WHEN ts >= top - 1e-14 THEN 1.0::DOUBLE / ties ELSE 0.0 END AS fractional_top1 FROM z JOIN tt USING (h, u)"""))
def _(b):
    return r6(_nested(b)[1], "true_score", "log_probability", "information")


LOAD = "ld AS (SELECT concat('F', f) AS feature, m::INT AS module, ((f * 7 + m * 13) % 11 - 5) / 10.0::DOUBLE AS loading FROM (SELECT DISTINCT p_partkey % 40 AS f FROM part), range(4) x(m))"


@query("i24_edge_deletion_sensitivity", lambda: with_views("effects", f""", {LOAD}, rk AS (SELECT *, row_number() OVER (PARTITION BY target, state ORDER BY abs(value) DESC, feature) AS position FROM effects), sc AS (SELECT target, state, module, sum(value * loading) AS s FROM effects JOIN ld USING (feature) GROUP BY ALL),
    nr AS (SELECT target, state, sum(value * value) AS n2 FROM effects GROUP BY ALL), c AS (SELECT r.target, r.state, r.feature, r.position, r.value, s.s AS s0, s.s - l.loading * r.value AS s1 FROM rk r JOIN sc s USING (target, state) JOIN ld l ON l.feature = r.feature AND l.module = s.module WHERE position <= 3),
    e AS (SELECT *, s0 * s0 / sum(s0 * s0) OVER w AS e0, s1 * s1 / sum(s1 * s1) OVER w AS e1 FROM c WINDOW w AS (PARTITION BY target, state, feature)), m AS (SELECT target, state, feature, position, value, max(e1) - max(e0) AS cc, 0.5 * sum(abs(e1 - e0)) AS rd FROM e GROUP BY ALL)
    SELECT target, state, feature, position, {D.q6('sqrt(greatest(1 - value * value / n2, 0)) - 1')} AS norm_change, {D.q6('cc')} AS concentration_change, {D.q6('rd')} AS redistribution, {D.q6('1 - sqrt(greatest(1 - value * value / n2, 0))')} AS signature_loss FROM m JOIN nr USING (target, state)"""))
def _(b):
    f = b.table("part").select((F.col("p_partkey") % 40).alias("f")).distinct()
    ld = f.select(F.concat(F.lit("F"), "f").alias("feature"), "f", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("module"))
    ld = ld.select("feature", "module", (((F.col("f") * 7 + F.col("module") * 13) % 11 - 5) / 10.0).alias("loading"))
    return r6(vx.edge_deletion_sensitivity(b.view("effects"), ld, ["target", "state"], 3), "norm_change", "concentration_change", "redistribution", "signature_loss")


@query("i25_module_spectrum_network", lambda: with_views("tensor", f""", c AS (SELECT a.module AS s, z.module AS t, corr(a.score, z.score) AS r FROM tensor a JOIN tensor z ON a.target = z.target AND a.state = 'A' AND z.state = 'A' AND a.module <> z.module GROUP BY ALL), q AS (SELECT quantile_cont(abs(r), 0.8) AS cut FROM c WHERE s < t)
    SELECT CAST(s AS VARCHAR) AS source, CAST(t AS VARCHAR) AS target, {D.q6('r')} AS weight FROM c, q WHERE abs(r) >= cut - 1e-12"""))
def _(b):
    return r6(dy.module_spectrum(b.view("tensor").filter("state = 'A'"), "target", 0.8)[0], "weight")


@query("i25_module_spectrum_growth")
def _(b):
    return dy.module_spectrum(b.view("tensor").filter("state = 'A'"), "target", 0.8)[1]
