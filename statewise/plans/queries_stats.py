"""Statistics and metric queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewise.operators import metrics as mx
from statewise.operators import ranks as rk
from statewise.operators import regression as rg
from statewise.operators import resample as rs
from statewise.operators import stats as st
from statewise.operators.groups import pivot_complete, shrink_targets
from statewise.plans.bindings import DUCK, q6
from statewise.plans.queries_groups import r6
from statewise.plans.queries_resample import boot, shuffled
from statewise.plans.registry import query, with_views

D = DUCK
STATES = ("A", "N", "R")
R = 30


def avg_rank(value: str, part: str) -> str:
    p = f"PARTITION BY {part}" if part else ""
    q = f"PARTITION BY {part}, {value}" if part else f"PARTITION BY {value}"
    return f"(rank() OVER ({p} ORDER BY {value}) + (count(*) OVER ({q}) - 1) / 2.0)"


@query("h1_spearman", lambda: with_views("passed", f"""
    SELECT state, count(*) AS n, {D.q6('corr(a, b)')} AS r FROM (SELECT state, {avg_rank('effect', 'state')} AS a, {avg_rank('cells', 'state')} AS b FROM passed) GROUP BY state"""))
def _(b):
    return r6(st.spearman(b.view("passed"), ["state"], "effect", "cells", False), "r")


@query("h1_pearson", lambda: f"SELECT l_returnflag, count(*) AS n, {D.q6('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem GROUP BY 1")
def _(b):
    return r6(st.correlation(b.table("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", "pearson", False), "r")


@query("h1_spearman_p")
def _(b):
    return st.spearman(b.view("passed"), ["state"], "effect", "cells")


@query("h2_kruskal", lambda: with_views("passed", f"""
    , r AS (SELECT cluster, effect, {avg_rank('effect', '')} AS r FROM passed WHERE cluster IS NOT NULL), g AS (SELECT sum(r) AS s, count(*) AS c FROM r GROUP BY cluster),
    t AS (SELECT sum(pow(c, 3) - c) AS tie FROM (SELECT count(*) AS c FROM r GROUP BY effect)), m AS (SELECT sum(c)::DOUBLE AS n, count(*) AS groups, sum(s * s / c) AS ss FROM g)
    SELECT n::BIGINT AS n, groups, {D.q6('(12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - tie / (n * n * n - n))')} AS h FROM m, t"""))
def _(b):
    return r6(st.kruskal(b.view("passed"), "cluster", "effect").drop("p_value"), "h")


LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


def _choose(n, k):
    return LC.format(n=f"({n})", k=f"({k})")


@query("h3_fisher_enrichment", lambda: f"""
    WITH u AS (SELECT p_partkey AS m, p_type AS set_id, p_size > 30 AS sel FROM part), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE sel) AS k FROM u),
    s AS (SELECT set_id, count(*) AS ns, count(*) FILTER (WHERE sel) AS a FROM u GROUP BY set_id),
    p AS (SELECT set_id, sum(exp({_choose('ns', 'i')} + {_choose('n - ns', 'k - i')} - {_choose('n', 'k')})) AS p FROM s, t, range(0, 3000) r(i) WHERE i BETWEEN a AND least(ns, k) GROUP BY set_id),
    c AS (SELECT *, ns - a AS b, k - a AS c, n - ns - k + a AS d FROM s, t)
    SELECT set_id, a, b, c, d, {D.q6('(a * d)::DOUBLE / (b * c)')} AS odds_ratio, {D.q6('ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))')} AS log_odds,
      {D.q6('ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) - 1.959963984540054::DOUBLE * sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5))')} AS ci_low,
      {D.q6('ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) + 1.959963984540054::DOUBLE * sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5))')} AS ci_high, {D.q6('least(p, 1)')} AS p_value FROM c JOIN p USING (set_id)""")
def _(b):
    part = b.table("part").select(F.col("p_partkey").alias("member"), F.col("p_type").alias("set_id"), "p_size")
    out = st.fisher_enrichment(part, part.filter("p_size > 30"), part)
    return r6(out, "odds_ratio", "log_odds", "ci_low", "ci_high", "p_value")


@query("h4_binomial_test", lambda: with_views("cis trans", f"""
    , j AS (SELECT c.snp_chrom, sign(c.z) = sign(t.z) AS hit FROM cis c JOIN trans t ON c.snp = t.snp AND c.z <> 0 AND t.z <> 0), s AS (SELECT snp_chrom, count(*) FILTER (WHERE hit) AS hits, count(*) AS n FROM j GROUP BY 1)
    SELECT snp_chrom, hits, n, {D.q6('least(sum(exp(' + _choose('n', 'i') + ' - n * ln(2))), 1)')} AS p_value FROM s, range(0, 40000) r(i) WHERE i BETWEEN hits AND n GROUP BY ALL"""))
def _(b):
    c, t = b.view("cis").filter("z <> 0").select("snp", "snp_chrom", F.col("z").alias("cz")), b.view("trans").filter("z <> 0").select("snp", F.col("z").alias("tz"))
    j = c.join(t, "snp").select("snp_chrom", (F.signum("cz") == F.signum("tz")).alias("hit"))
    return r6(st.binomial_test(j, ["snp_chrom"], "hit"), "p_value")


@query("h5_wilcoxon_paired", lambda: with_views("summary", f"""
    , d AS (SELECT a.effect - n.effect AS d FROM summary a JOIN summary n ON a.target = n.target AND a.state = 'A' AND n.state = 'N' WHERE a.effect <> n.effect), r AS (SELECT d, abs(d) AS m, {avg_rank('abs(d)', '')} AS r FROM d),
    t AS (SELECT sum(pow(c, 3) - c) AS tie FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY m)), s AS (SELECT count(*) AS n, sum(r) FILTER (WHERE d > 0) AS w FROM r)
    SELECT n, w AS w_plus, {D.q6('(w - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tie / 48)')} AS z FROM s, t"""))
def _(b):
    w = pivot_complete(b.view("summary"), ["target"], "state", ["A", "N"], "effect")
    return r6(st.wilcoxon_paired(w, [], "effect_A", "effect_N").drop("p_value"), "z")


@query("h6_direction_agreement", lambda: with_views("effects", f"""
    , j AS (SELECT e.state, sign(e.value) = sign(x.value) AS hit FROM effects e JOIN effects x ON e.target = x.target AND e.feature = x.feature AND x.state = 'A')
    SELECT state, count(*) AS n, count(*) FILTER (WHERE hit) AS matches, {D.q6('count(*) FILTER (WHERE hit)::DOUBLE / count(*)')} AS agreement FROM j GROUP BY GROUPING SETS ((), (state))"""))
def _(b):
    e = b.view("effects")
    a = e.filter("state = 'A'").select("target", "feature", F.col("value").alias("reference"))
    return r6(st.direction_agreement(e.join(a, ["target", "feature"]), "state", "value", "reference"), "agreement")


OLS_VIEW = "SELECT p_brand AS cluster, ln(p_retailprice) * 10 AS y, p_size::DOUBLE / 10 AS x1, (p_type = 'ECONOMY')::INT::DOUBLE AS x2 FROM part"


def _ols(b):
    return b.table("part").select(F.col("p_brand").alias("cluster"), (F.log("p_retailprice") * 10).alias("y"), (F.col("p_size").cast("double") / 10).alias("x1"),
                                  (F.col("p_type") == "ECONOMY").cast("int").cast("double").alias("x2"))


def _normal_equations(rest: str) -> str:
    """Two-covariate least squares in closed form (centred)."""
    return f"""WITH t AS ({OLS_VIEW}), m AS (SELECT count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v11, var_pop(x2) AS v22, covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM t),
      f AS (SELECT *, v11 * v22 - v12 * v12 AS det, (c1 * v22 - c2 * v12) / (v11 * v22 - v12 * v12) AS b1, (c2 * v11 - c1 * v12) / (v11 * v22 - v12 * v12) AS b2 FROM m),
      e AS (SELECT t.*, f.*, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e FROM t, f) {rest}"""


@query("h7_ols_cluster", lambda: _normal_equations(f"""
      , s AS (SELECT cluster, sum(e * (x1 - m1)) AS s1, sum(e * (x2 - m2)) AS s2 FROM e GROUP BY cluster), w AS (SELECT count(*) AS g, sum(s1 * s1) AS w11, sum(s1 * s2) AS w12, sum(s2 * s2) AS w22 FROM s),
      v AS (SELECT b1, b2, g, (g / (g - 1.0)) * ((n - 1) / (n - 3)) AS k, v22 / det / n AS i11, -v12 / det / n AS i12, v11 / det / n AS i22, w11, w12, w22 FROM f, w)
      SELECT 'x1' AS term, {D.q6('b1')} AS estimate, {D.q6('sqrt(k * (i11 * i11 * w11 + 2 * i11 * i12 * w12 + i12 * i12 * w22))')} AS se, g AS clusters FROM v
      UNION ALL SELECT 'x2', {D.q6('b2')}, {D.q6('sqrt(k * (i12 * i12 * w11 + 2 * i12 * i22 * w12 + i22 * i22 * w22))')}, g FROM v"""))
def _(b):
    out = rg.ols_cluster(_ols(b), "y", ["x1", "x2"], "cluster").filter("term <> 'intercept'")
    return r6(out.select("term", "estimate", "se", "clusters"), "estimate", "se")


@query("h8_residualized_slope", lambda: _normal_equations(f"SELECT {D.q6('b1')} AS estimate, n::BIGINT AS n FROM f"))
def _(b):
    return r6(rg.residualized_slope(_ols(b), "y", "x1", ["x2"], "cluster", R, 3)[0], "estimate")


@query("h8_residualized_bootstrap", lambda: _normal_equations(f"""
      , r AS (SELECT cluster, x1 - m1 - v12 / v22 * (x2 - m2) AS rx, y - my - c2 / v22 * (x2 - m2) AS ry FROM e), {boot('t', 'cluster', 3)}
      SELECT replicate, {D.q6('sum(rx * ry) / sum(rx * rx)')} AS value FROM dr JOIN u USING (idx) JOIN r ON r.cluster = k GROUP BY replicate"""))
def _(b):
    return r6(rg.residualized_slope(_ols(b), "y", "x1", ["x2"], "cluster", R, 3)[1], "value")


@query("h9_influence", lambda: _normal_equations(f"""
      , h AS (SELECT *, 1 / n + ((x1 - m1) * (x1 - m1) * v22 - 2 * (x1 - m1) * (x2 - m2) * v12 + (x2 - m2) * (x2 - m2) * v11) / det / n AS h FROM e), q AS (SELECT sum(e * e) / (count(*) - 3) AS mse FROM h)
      SELECT cluster, {D.q6('max(h)')} AS leverage, {D.q6('max(e * e * h / (3 * mse * pow(1 - h, 2)))')} AS cooks_distance, count(*) AS rows FROM h, q GROUP BY cluster"""))
def _(b):
    return r6(rg.influence(_ols(b), "y", ["x1", "x2"], "cluster"), "leverage", "cooks_distance")


METRIC_SQL = "count(*) AS n, {r2} AS r2, {mae} AS mae, {rmse} AS rmse, {pearson} AS pearson, {slope} AS slope, {intercept} AS intercept"


@query("h10_regression_metrics", lambda: with_views("summary", f"""
    , r AS (SELECT state, downstream::DOUBLE AS y, cells / 2.0::DOUBLE AS p, {avg_rank('downstream', 'state')} AS a, {avg_rank('cells', 'state')} AS b FROM summary)
    SELECT state, count(*) AS n, {D.q6('1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))')} AS r2, {D.q6('avg(abs(y - p))')} AS mae, {D.q6('sqrt(avg(pow(y - p, 2)))')} AS rmse, {D.q6('corr(y, p)')} AS pearson,
      {D.q6('regr_slope(y, p)')} AS slope, {D.q6('regr_intercept(y, p)')} AS intercept, {D.q6('corr(a, b)')} AS spearman FROM r GROUP BY state"""))
def _(b):
    s = b.view("summary").select("state", F.col("downstream").cast("double").alias("y"), (F.col("cells") / 2.0).alias("p"))
    out = mx.regression_metrics(s, ["state"], "y", "p")
    return r6(out, "r2", "mae", "rmse", "pearson", "slope", "intercept", "spearman")


AUROC_SQL = "(sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)"


@query("h11_auroc", lambda: with_views("scored", f"""
    SELECT dataset, {D.q6(AUROC_SQL)} AS auroc FROM (SELECT dataset, y, {avg_rank('score_a', 'dataset')} AS r FROM scored) GROUP BY dataset"""))
def _(b):
    return r6(mx.auroc(b.view("scored"), ["dataset"], "y", "score_a"), "auroc")


AP_SQL = """ap AS (SELECT {by}, sum(pos * tp / n) / sum(pos) AS ap FROM (SELECT *, sum(pos) OVER w AS tp, sum(c) OVER w AS n FROM (SELECT {by}, {s} AS s, sum(y) AS pos, count(*) AS c FROM {src} GROUP BY ALL) WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)) GROUP BY {by})"""


@query("h12_average_precision", lambda: with_views("scored", ", " + AP_SQL.format(by="dataset", s="score_a", src="scored") + f" SELECT dataset, {D.q6('ap')} AS average_precision FROM ap"))
def _(b):
    return r6(mx.average_precision(b.view("scored"), ["dataset"], "y", "score_a"), "average_precision")


EPR_SQL = """ep AS (SELECT {by}, sum(CASE WHEN rn <= p THEN y ELSE 0 END) * max(n)::DOUBLE / (max(p) * max(p)) AS epr FROM (SELECT *, sum(y) OVER (PARTITION BY {by}) AS p, count(*) OVER (PARTITION BY {by}) AS n,
      row_number() OVER (PARTITION BY {by} ORDER BY {s} DESC, md5(concat_ws('|', {key})), {key}) AS rn FROM {src}) GROUP BY {by} HAVING max(p) BETWEEN 1 AND max(n) - 1)"""


# with the groups of one class: 1 if all are positive, null if none is
EPR_ALL_SQL = EPR_SQL.replace(" HAVING max(p) BETWEEN 1 AND max(n) - 1", "").replace("(max(p) * max(p))", "nullif(max(p) * max(p), 0)")


@query("h13_early_precision_ratio", lambda: with_views("scored", ", " + EPR_ALL_SQL.format(by="dataset", s="score_a", key="unit", src="scored") + f" SELECT dataset, {D.q6('epr')} AS early_precision_ratio FROM ep"))
def _(b):
    return r6(mx.early_precision_ratio(b.view("scored"), ["dataset"], "y", "score_a", ["unit"]), "early_precision_ratio")


CAND = "SELECT 'one' AS dataset, response % 60 AS target, source AS regulator, state, abs(effect) AS score, (direction = 1)::INT AS y, concat_ws('-', source, response, state) AS edge FROM edges"


def _cand(b):
    return b.view("edges").select(F.lit("one").alias("dataset"), (F.col("response") % 60).alias("target"), F.col("source").alias("regulator"), F.abs("effect").alias("score"),
                                  (F.col("direction") == 1).cast("int").alias("y"), F.concat_ws("-", "source", "response", "state").alias("edge"))


def _macro_ctes():
    return f""", c AS ({CAND}), au AS (SELECT target, {AUROC_SQL} AS auroc FROM (SELECT target, y, {avg_rank('score', 'target')} AS r FROM c) GROUP BY target),
      {AP_SQL.format(by='target', s='score', src='c')}, {EPR_SQL.format(by='target', s='score', key='edge', src='c')},
      m AS (SELECT target, 'auroc' AS metric, auroc AS v FROM au WHERE auroc IS NOT NULL UNION ALL SELECT target, 'auprc', ap FROM ap JOIN ep USING (target) UNION ALL SELECT target, 'early_precision_ratio', epr FROM ep)"""


@query("h14_target_metrics", lambda: with_views("edges", _macro_ctes() + f" SELECT target, metric, {D.q6('v')} AS v FROM m"))
def _(b):
    t = mx.target_metrics(_cand(b), ["target"], "y", "score", ["edge"])
    return r6(t.unpivot(["target"], ["auroc", "auprc", "early_precision_ratio"], "metric", "v"), "v")


@query("h14_macro_metrics", lambda: with_views("edges", _macro_ctes() + f""",
      ux AS (SELECT metric, target, v, row_number() OVER (PARTITION BY metric ORDER BY md5(concat_ws('|', target)), target) - 1 AS idx, count(*) OVER (PARTITION BY metric) AS n FROM m),
      dr AS (SELECT metric, r AS replicate, {D.draw('n', "'5'", "'one'", 'metric', 'r', 'idx')} AS idx FROM ux, range({R}) x(r)), bs AS (SELECT metric, replicate, avg(v) AS v FROM dr JOIN ux USING (metric, idx) GROUP BY ALL)
      SELECT 'one' AS dataset, metric, {D.q6('max(e)')} AS estimate, max(k) AS targets, {D.q6('quantile_cont(v, 0.025)')} AS ci_low, {D.q6('quantile_cont(v, 0.975)')} AS ci_high
      FROM bs JOIN (SELECT metric, avg(v) AS e, count(*) AS k FROM m GROUP BY metric) USING (metric) GROUP BY metric"""))
def _(b):
    return r6(mx.macro_metrics(_cand(b), ["dataset"], "target", "y", "score", ["edge"], R, 5), "estimate", "ci_low", "ci_high")


def _contrast_ctes():
    def parts(k, s):
        ap = AP_SQL.format(by="target", s=s, src="c").replace("ap AS (", f"ap{k} AS (", 1)
        ep = EPR_SQL.format(by="target", s=s, key="edge", src="c").replace("ep AS (", f"ep{k} AS (", 1)
        return f"au{k} AS (SELECT target, {AUROC_SQL} AS auroc FROM (SELECT target, y, {avg_rank(s, 'target')} AS r FROM c) GROUP BY target), {ap}, {ep}"

    return f""", c AS (SELECT response % 60 AS target, abs(effect) AS score, ((response * 7 + source) % 100)::DOUBLE / 100 AS other, (direction = 1)::INT AS y, concat_ws('-', source, response, state) AS edge FROM edges),
      {parts(1, 'score')}, {parts(2, 'other')},
      m AS (SELECT target, 'auroc' AS metric, au1.auroc AS a, au2.auroc AS b FROM au1 JOIN au2 USING (target) WHERE au1.auroc IS NOT NULL UNION ALL SELECT target, 'auprc', ap1.ap, ap2.ap FROM ap1 JOIN ap2 USING (target) JOIN ep1 USING (target)
        UNION ALL SELECT target, 'early_precision_ratio', ep1.epr, ep2.epr FROM ep1 JOIN ep2 USING (target)),
      e AS (SELECT metric, count(*) AS targets, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS difference FROM m GROUP BY metric),
      ux AS (SELECT metric, a - b AS v, row_number() OVER (PARTITION BY metric ORDER BY md5(concat_ws('|', target)), target) - 1 AS idx, count(*) OVER (PARTITION BY metric) AS n FROM m),
      dr AS (SELECT metric, r AS replicate, {D.draw('n', "'5'", "'one'", 'metric', 'r', 'idx')} AS idx FROM ux, range({R}) x(r)), bs AS (SELECT metric, replicate, avg(v) AS v FROM dr JOIN ux USING (metric, idx) GROUP BY ALL),
      s AS (SELECT metric, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, stddev_samp(v) AS standard_error, (count(*) FILTER (WHERE abs(v - difference) >= abs(difference)) + 1)::DOUBLE / {R + 1} AS p_value FROM bs JOIN e USING (metric) GROUP BY metric),
      b AS (SELECT *, p_value * count(*) OVER () / count(*) OVER (ORDER BY p_value) AS raw FROM s), f AS (SELECT *, least(min(raw) OVER (ORDER BY p_value DESC), 1) AS q_value FROM b)"""


@query("h31_paired_contrasts", lambda: with_views("edges", _contrast_ctes() + f"""
    SELECT 'one' AS dataset, metric, targets, {', '.join(f"{D.q6(x)} AS {x}" for x in ('mean_a', 'mean_b', 'difference', 'ci_low', 'ci_high', 'standard_error', 'p_value', 'q_value'))},
      CASE WHEN targets < 50 THEN 'underpowered' WHEN q_value < 0.05 AND ci_low > 0 THEN 'a_superior' WHEN q_value < 0.05 AND ci_high < 0 THEN 'b_superior' ELSE 'unresolved' END AS result FROM f JOIN e USING (metric)"""))
def _(b):
    c = b.view("edges").select(F.lit("one").alias("dataset"), (F.col("response") % 60).alias("target"), F.abs("effect").alias("score"), (((F.col("response") * 7 + F.col("source")) % 100).cast("double") / 100).alias("other"),
                               (F.col("direction") == 1).cast("int").alias("y"), F.concat_ws("-", "source", "response", "state").alias("edge"))
    out = mx.paired_contrasts(c, ["dataset"], "target", "y", "score", "other", ["edge"], 50, 0.05, R, 5)
    return r6(out, "mean_a", "mean_b", "difference", "ci_low", "ci_high", "standard_error", "p_value", "q_value")


def _ll(p):
    return f"avg(-(y * ln(least(greatest({p}, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12))))"


@query("h15_brier_log_loss", lambda: with_views("scored", f"""
    , m AS (SELECT dataset, count(*) AS n, avg(pow(y - score_a, 2)) AS ba, avg(pow(y - score_b, 2)) AS bb, {_ll('score_a')} AS la, {_ll('score_b')} AS lb FROM scored GROUP BY dataset)
    SELECT dataset, n, {D.q6('ba')} AS brier_a, {D.q6('bb')} AS brier_b, {D.q6('la')} AS log_loss_a, {D.q6('lb')} AS log_loss_b, {D.q6('ba - bb')} AS brier_improvement, {D.q6('la - lb')} AS log_loss_improvement FROM m"""))
def _(b):
    out = mx.loss_improvement(b.view("scored"), ["dataset"], "y", "score_a", "score_b")
    return r6(out, *[c for c in out.columns if c not in ("dataset", "n")])


@query("h16_calibration_table", lambda: with_views("scored", f"""
    , r AS (SELECT *, row_number() OVER (ORDER BY score_a, md5(concat_ws('|', unit)), unit) AS r, count(*) OVER () AS n FROM scored), k AS (SELECT *, greatest(ceil((r - 1) * 10::DOUBLE / (n - 1)) - 1, 0)::INT AS bin FROM r),
    g AS (SELECT bin, cluster, count(*) AS c, sum(y) AS sy FROM k GROUP BY ALL), ux AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('|', cluster)), cluster) - 1 AS idx, count(*) OVER (PARTITION BY bin) AS m FROM g),
    dr AS (SELECT bin, r AS replicate, {D.draw('m', "'6'", 'bin', 'r', 'idx')} AS idx FROM ux, range({R}) x(r)), bs AS (SELECT bin, replicate, sum(sy)::DOUBLE / sum(c) AS v FROM dr JOIN ux USING (bin, idx) GROUP BY ALL),
    ci AS (SELECT bin, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM bs GROUP BY bin)
    SELECT bin, count(*) AS rows, count(DISTINCT cluster) AS clusters, {D.q6('avg(score_a)')} AS predicted, {D.q6('avg(y)')} AS observed, {D.q6('avg(score_a) - avg(y)')} AS gap, {D.q6('lo')} AS ci_low, {D.q6('hi')} AS ci_high FROM k JOIN ci USING (bin) GROUP BY bin, lo, hi"""))
def _(b):
    return r6(mx.calibration_table(b.view("scored"), "score_a", "y", "cluster", ["unit"], 10, False, R, 6), "predicted", "observed", "gap", "ci_low", "ci_high")


@query("h16_fixed_bins", lambda: with_views("scored", f"""
    SELECT least(floor(score_b * 10), 9)::INT AS bin, count(*) AS rows, count(DISTINCT cluster) AS clusters, {D.q6('avg(score_b)')} AS predicted, {D.q6('avg(y)')} AS observed, {D.q6('avg(score_b) - avg(y)')} AS gap FROM scored GROUP BY 1"""))
def _(b):
    return r6(mx.calibration_table(b.view("scored"), "score_b", "y", "cluster", ["unit"], 10, True), "predicted", "observed", "gap")


HELD = f""", c AS ({CAND}), r AS (SELECT *, row_number() OVER (ORDER BY score, md5(concat_ws('|', edge)), edge) - 1 AS r, count(*) OVER () AS n FROM c), k AS (SELECT *, least(floor(r * 10::DOUBLE / n), 9)::INT AS bin FROM r),
    q AS (SELECT *, (sum(y) OVER (PARTITION BY bin) - sum(y) OVER (PARTITION BY bin, target))::DOUBLE / (count(*) OVER (PARTITION BY bin) - count(*) OVER (PARTITION BY bin, target)) AS q FROM k)"""


@query("h17_heldout_bins", lambda: with_views("edges", HELD + f"""
    SELECT 'one' AS dataset, bin, count(*) AS n_edges, count(DISTINCT target) AS n_targets, sum(y)::BIGINT AS gold_edges, {D.q6('avg(q)')} AS mean_probability, {D.q6('avg(y)')} AS observed, {D.q6('abs(avg(q) - avg(y))')} AS gap, {D.q6('avg(pow(q - y, 2))')} AS bin_brier FROM q GROUP BY bin"""))
def _(b):
    return r6(mx.heldout_rank_calibration(_cand(b), ["dataset"], "target", "y", "score", ["edge"])[0], "mean_probability", "observed", "gap", "bin_brier")


@query("h17_heldout_overall", lambda: with_views("edges", HELD + f"""
    , p AS (SELECT bin, count(*) AS n, abs(avg(q) - avg(y)) AS gap, sum(pow(q - y, 2)) AS se FROM q GROUP BY bin) SELECT 'one' AS dataset, {D.q6('sum(se) / sum(n)')} AS brier, {D.q6('sum(gap * n) / sum(n)')} AS ece FROM p"""))
def _(b):
    return r6(mx.heldout_rank_calibration(_cand(b), ["dataset"], "target", "y", "score", ["edge"])[1], "brier", "ece")


@query("h18_split_conformal", lambda: with_views("passed", f"""
    , c AS (SELECT state, abs(effect) AS a, target % 2 AS side FROM passed), o AS (SELECT state, a, row_number() OVER (PARTITION BY state ORDER BY a) AS k, count(*) OVER (PARTITION BY state) AS n FROM c WHERE side = 0),
    r AS (SELECT state, lv AS level, n AS calibration_n, a AS radius FROM o, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE)) v(lv) WHERE k = least(n, ceil((n + 1) * lv)))
    SELECT r.state, level, calibration_n, {D.q6('radius')} AS radius, count(*) AS test_n, {D.q6('avg((a <= radius)::INT)')} AS coverage, {D.q6('2 * radius')} AS width FROM r JOIN c ON c.state = r.state AND side = 1 GROUP BY r.state, level, calibration_n, radius"""))
def _(b):
    p = b.view("passed")
    return r6(mx.split_conformal(p.filter("target % 2 = 0"), p.filter("target % 2 = 1"), ["state"], "effect", [0.5, 0.8, 0.95]), "radius", "coverage", "width")


@query("h19_residual_interval", lambda: with_views("passed", f"""
    , q AS (SELECT state, lv AS level, quantile_cont(effect, (1 - lv) / 2) AS low, quantile_cont(effect, (1 + lv) / 2) AS high FROM passed, (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) v(lv) WHERE target % 2 = 0 GROUP BY state, lv)
    SELECT q.state, level, {D.q6('low')} AS low, {D.q6('high')} AS high, count(*) AS test_n, {D.q6('avg((effect BETWEEN low AND high)::INT)')} AS coverage FROM q JOIN passed p ON p.state = q.state AND target % 2 = 1 GROUP BY q.state, level, low, high""".replace(
    "quantile_cont(effect, (1 - lv) / 2)", "CASE WHEN lv = 0.5 THEN quantile_cont(effect, 0.25) ELSE quantile_cont(effect, 0.1) END").replace("quantile_cont(effect, (1 + lv) / 2)", "CASE WHEN lv = 0.5 THEN quantile_cont(effect, 0.75) ELSE quantile_cont(effect, 0.9) END")))
def _(b):
    p = b.view("passed")
    return r6(mx.residual_interval(p.filter("target % 2 = 0"), p.filter("target % 2 = 1"), ["state"], "effect", [0.5, 0.8]), "low", "high", "coverage")


RISK = ", x AS (SELECT state, target, abs(effect) AS error, cells, guides, downstream FROM passed)"


def _risk(b):
    return b.view("passed").select("state", "target", F.abs("effect").alias("error"), "cells", "guides", "downstream")


def _sel(s, order):
    return f"SELECT state, target, error, '{s}' AS selector, row_number() OVER (PARTITION BY state ORDER BY {s} {order}, md5(concat_ws('|', target)), target) AS pos, count(*) OVER (PARTITION BY state) AS n FROM x"


SELECTORS = {"cells": False, "guides": False, "downstream": True}
SEL_SQL = " UNION ALL ".join(_sel(s, "ASC" if up else "DESC") for s, up in SELECTORS.items())


@query("h20_risk_coverage", lambda: with_views("passed", f"""{RISK}, r AS ({SEL_SQL})
    SELECT state, selector, cv AS coverage, count(*) AS selected, {D.q6('avg(error)', 8)} AS risk, {D.q6('stddev_samp(error)', 8)} AS risk_sd FROM r, (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) v(cv) WHERE pos <= greatest(ceil(n * cv), 1) GROUP BY ALL"""))
def _(b):
    out = mx.risk_coverage(_risk(b), ["state"], ["target"], "error", SELECTORS, [0.2, 0.5, 0.8, 1.0])
    return out.withColumns({"risk": q6("risk", 8), "risk_sd": q6("risk_sd", 8)})


@query("h21_selector_comparison", lambda: with_views("passed", f"""{RISK}, r AS ({SEL_SQL}), k AS (SELECT * FROM r WHERE pos <= greatest(ceil(n * 0.8::DOUBLE), 1)),
    ux AS (SELECT state, target, row_number() OVER (PARTITION BY state ORDER BY md5(concat_ws('|', target)), target) - 1 AS idx, count(*) OVER (PARTITION BY state) AS m FROM x),
    dr AS (SELECT state, r AS replicate, {D.draw('m', "'8'", 'state', 'r', 'idx')} AS idx FROM ux, range({R}) z(r)), s AS (SELECT dr.state, replicate, selector, avg(error) AS a FROM dr JOIN ux USING (state, idx) JOIN k USING (state, target) GROUP BY ALL),
    d AS (SELECT o.state, o.replicate, o.selector AS comparator, o.a - c.a AS v FROM s o JOIN s c ON o.state = c.state AND o.replicate = c.replicate AND c.selector = 'cells' AND o.selector <> 'cells'),
    ob AS (SELECT state, selector, avg(error) AS risk, avg((error > 0.01)::INT) AS bad FROM k GROUP BY ALL)
    SELECT d.state, comparator, {D.q6('c.risk')} AS chosen_risk, {D.q6('o.risk')} AS comparator_risk, {D.q6('c.bad')} AS chosen_bad_rate, {D.q6('o.bad')} AS comparator_bad_rate, {D.q6('o.risk - c.risk')} AS improvement,
      {D.q6('quantile_cont(v, 0.025)')} AS ci_low, {D.q6('quantile_cont(v, 0.975)')} AS ci_high, {D.q6('(1 + count(*) FILTER (WHERE v <= 0)) / (count(*) + 1.0)')} AS p_value
    FROM d JOIN ob o ON o.state = d.state AND o.selector = comparator JOIN ob c ON c.state = d.state AND c.selector = 'cells' GROUP BY d.state, comparator, c.risk, o.risk, c.bad, o.bad"""))
def _(b):
    x = _risk(b).withColumn("limit", F.lit(0.01))
    out = mx.selector_comparison(x, ["state"], ["target"], "target", "error", "limit", "cells", SELECTORS, 0.8, R, 8)
    return r6(out, *[c for c in out.columns if c not in ("state", "comparator")])


META = "m AS (SELECT l_returnflag AS family, l_suppkey % 12 AS study, avg(l_discount) * 10 AS e, stddev_samp(l_discount) * 10 / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL)"


@query("h22_random_effects", lambda: f"""
    WITH {META}, w AS (SELECT *, 1 / (se * se) AS w FROM m), s AS (SELECT family, count(*) AS k, sum(w) AS sw, sum(w * w) AS sww, sum(w * e) / sum(w) AS fe FROM w GROUP BY family), q AS (SELECT family, sum(w * pow(e - fe, 2)) AS q FROM w JOIN s USING (family) GROUP BY family),
    t AS (SELECT *, greatest(0, (q - (k - 1)) / (sw - sww / sw)) AS tau2 FROM s JOIN q USING (family)), r AS (SELECT family, sum(e / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS re, sqrt(1 / sum(1 / (se * se + tau2))) AS rse FROM m JOIN t USING (family) GROUP BY family)
    SELECT family, k, {D.q6('fe')} AS fixed_effect, {D.q6('q')} AS q, {D.q6('tau2')} AS tau2, {D.q6('CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) * 100 ELSE 0 END')} AS i2, {D.q6('re')} AS random_effect, {D.q6('rse')} AS random_se,
      {D.q6('re - 1.959963984540054::DOUBLE * rse')} AS ci_low, {D.q6('re + 1.959963984540054::DOUBLE * rse')} AS ci_high, {D.q6('re - 1.959963984540054::DOUBLE * sqrt(tau2 + rse * rse)')} AS prediction_low, {D.q6('re + 1.959963984540054::DOUBLE * sqrt(tau2 + rse * rse)')} AS prediction_high FROM t JOIN r USING (family)""")
def _(b):
    m = b.table("lineitem").groupBy(F.col("l_returnflag").alias("family"), (F.col("l_suppkey") % 12).alias("study")).agg(
        (F.avg("l_discount") * 10).alias("e"), (F.stddev_samp("l_discount") * 10 / F.sqrt(F.count(F.lit(1)))).alias("se"))
    out = st.random_effects(m, ["family"], "e", "se")
    return r6(out, *[c for c in out.columns if c not in ("family", "k")])


@query("h23_reliability_bounds", lambda: with_views("passed", f"""
    , ux AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5(concat_ws('|', target)), target) - 1 AS idx, count(*) OVER (PARTITION BY state) AS m FROM passed), dr AS (SELECT state, r AS replicate, {D.draw('m', "'12'", 'state', 'r', 'idx')} AS idx FROM ux, range({R}) z(r)),
    d AS (SELECT state, replicate, quantile_cont(effect * 10, 0.5) AS v FROM dr JOIN ux USING (state, idx) GROUP BY state, replicate),
    o AS (SELECT state, quantile_cont(effect * 10, 0.5) AS o FROM passed GROUP BY state), l AS (SELECT state, v, CASE WHEN v >= 0 THEN v ELSE greatest(-1, v / 0.1) END AS lo, CASE WHEN v >= 0 THEN least(1, v / 0.1) ELSE v END AS hi FROM d)
    SELECT state, {D.q6('max(o)')} AS observed, {D.q6('CASE WHEN max(o) >= 0 THEN max(o) ELSE greatest(-1, max(o) / 0.1) END')} AS corrected_lower, {D.q6('CASE WHEN max(o) >= 0 THEN least(1, max(o) / 0.1) ELSE max(o) END')} AS corrected_upper,
      {D.q6('quantile_cont(v, 0.025)')} AS ci_low, {D.q6('quantile_cont(v, 0.975)')} AS ci_high, {D.q6('quantile_cont(lo, 0.025)')} AS lower_ci_low, {D.q6('quantile_cont(hi, 0.975)')} AS upper_ci_high FROM l JOIN o USING (state) GROUP BY state"""))
def _(b):
    p = b.view("passed").select("state", "target", (F.col("effect") * 10).alias("effect"))
    out = st.reliability_bounds(p, "target", "effect", 0.1, R, 12, ["state"])
    return r6(out, *[c for c in out.columns if c != "state"])


@query("h24_paired_state_test", lambda: with_views("summary", f"""
    , w AS (SELECT target, max(effect) FILTER (WHERE state = 'A') AS a, max(effect) FILTER (WHERE state = 'N') AS n, max(effect) FILTER (WHERE state = 'R') AS r FROM summary GROUP BY target HAVING count(*) = 3),
    l AS (SELECT target, 'effect_A-effect_N' AS contrast, a - n AS d FROM w UNION ALL SELECT target, 'effect_A-effect_R', a - r FROM w), ux AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY md5(concat_ws('|', target)), target) - 1 AS idx, count(*) OVER (PARTITION BY contrast) AS m FROM l),
    dr AS (SELECT contrast, r AS replicate, {D.draw('m', "'4'", 'contrast', 'r', 'idx')} AS idx FROM ux, range({R}) z(r)), bs AS (SELECT contrast, replicate, avg(d) AS v FROM dr JOIN ux USING (contrast, idx) GROUP BY ALL),
    nl AS (SELECT contrast, r AS replicate, avg(d * (1 - 2 * {D.draw(2, "'4'", 'r', 'target')})) AS v FROM l, range({R}) z(r) GROUP BY ALL), o AS (SELECT contrast, count(*) AS n, avg(d) AS e, quantile_cont(d, 0.5) AS md FROM l GROUP BY contrast),
    ci AS (SELECT contrast, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM bs GROUP BY contrast), p AS (SELECT contrast, (1 + count(*) FILTER (WHERE abs(v) >= abs(e) - 1e-12)) / (count(*) + 1.0) AS p FROM nl JOIN o USING (contrast) GROUP BY contrast)
    SELECT contrast, n, {D.q6('e', 8)} AS mean_difference, {D.q6('md', 8)} AS median_difference, {D.q6('lo', 8)} AS ci_low, {D.q6('hi', 8)} AS ci_high, {D.q6('p', 8)} AS p_value FROM o JOIN ci USING (contrast) JOIN p USING (contrast)"""))
def _(b):
    w = pivot_complete(b.view("summary"), ["target"], "state", STATES, "effect")
    out = st.paired_state_test(w, "target", [("effect_A", "effect_N"), ("effect_A", "effect_R")], R, 4)
    return out.withColumns({c: q6(c, 8) for c in out.columns if c not in ("contrast", "n")})


@query("h25_group_difference", lambda: with_views("passed", f"""
    , {boot('passed', 'target', 15, where="state IN ('A', 'R')")}, g AS (SELECT replicate, avg(cells) FILTER (WHERE state = 'A') - avg(cells) FILTER (WHERE state = 'R') AS v FROM dr JOIN u USING (idx) JOIN passed ON target = k GROUP BY replicate),
    c AS (SELECT quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM g), o AS (SELECT count(*) FILTER (WHERE state = 'A') AS positive_n, count(*) FILTER (WHERE state = 'R') AS negative_n, avg(cells) FILTER (WHERE state = 'A') - avg(cells) FILTER (WHERE state = 'R') AS d FROM passed)
    SELECT positive_n, negative_n, {D.q6('d')} AS difference, {D.q6('lo')} AS ci_low, {D.q6('hi')} AS ci_high, CASE WHEN lo > 0 THEN 'higher' WHEN hi < 0 THEN 'lower' ELSE 'unresolved' END AS decision FROM o, c"""))
def _(b):
    out = st.group_difference(b.view("passed"), "state", "A", "R", "cells", "target", R, 15)
    return out.select(F.col("positive_n").cast("bigint").alias("positive_n"), F.col("negative_n").cast("bigint").alias("negative_n"), q6("difference").alias("difference"),
                      q6("ci_low").alias("ci_low"), q6("ci_high").alias("ci_high"), "decision")


SHRINK = """, t AS (SELECT target, count(effect) AS o, avg(effect) AS u, var_pop(effect) AS vp FROM passed GROUP BY target), s AS (SELECT sum(vp * o) / sum(o - 1) AS s2, var_samp(u) AS vu, avg(1.0::DOUBLE / o) AS inv FROM t),
    g AS (SELECT target, u, mp AS multiplier, CASE WHEN vu - s2 * inv > 0 THEN (vu - s2 * inv) / ((vu - s2 * inv) + mp * s2 / o) ELSE 0 END AS w FROM t, s, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) v(mp))"""


@query("h26_measurement_error_sensitivity", lambda: with_views("passed", SHRINK + f"""
    , r AS (SELECT multiplier, w, {avg_rank('u', 'multiplier')} AS a, rank() OVER (PARTITION BY multiplier ORDER BY round(w * u, 12)) + (count(*) OVER (PARTITION BY multiplier, round(w * u, 12)) - 1) / 2.0 AS b FROM g)
    SELECT multiplier, {D.q6('quantile_cont(w, 0.5)')} AS median_weight, count(*) AS n, {D.q6('corr(a, b)', 4)} AS spearman FROM r GROUP BY multiplier"""))
def _(b):
    out = st.measurement_error_sensitivity(b.view("passed"), "target", "effect", [0.5, 1.0, 2.0])
    return r6(out, "median_weight").withColumn("spearman", q6("spearman", 4))


@query("h26_covariate_noise", lambda: with_views("passed", f"""
    , s AS (SELECT state, stddev_samp(cells) AS sd FROM passed GROUP BY state), n AS (SELECT state, sc AS scale, r AS replicate, effect AS y, cells + sc * sd * sqrt(-2 * ln({D.uniform("'6'", 'r', 'target', "'a'")})) * cos(2 * pi() * {D.uniform("'6'", 'r', 'target', "'b'")}) AS x
      FROM passed JOIN s USING (state), (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) v(sc), range(10) z(r)), k AS (SELECT state, scale, replicate, regr_slope(y, x) AS sl FROM n GROUP BY ALL)
    SELECT state, scale, {D.q6('avg(sl)', 9)} AS mean_slope, {D.q6('min(sl)', 9)} AS min_slope, {D.q6('max(sl)', 9)} AS max_slope FROM k GROUP BY state, scale"""))
def _(b):
    out = st.covariate_noise_sensitivity(b.view("passed"), "target", "effect", "cells", [0.1, 0.5], 10, 6, ["state"])
    return out.withColumns({c: q6(c, 9) for c in ("mean_slope", "min_slope", "max_slope")})


@query("h27_centroid_covariance", lambda: with_views("passed", f"""
    , ux AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5(concat_ws('|', target)), target) - 1 AS idx, count(*) OVER (PARTITION BY state) AS m FROM passed), dr AS (SELECT state, r AS replicate, {D.draw('m', "'2'", 'state', 'r', 'idx')} AS idx FROM ux, range({R}) z(r)),
    c AS (SELECT state, replicate, avg(effect * 100) AS x, avg(cells) AS z FROM dr JOIN ux USING (state, idx) GROUP BY ALL), k AS (SELECT state, count(*) AS units, avg(effect * 100) AS cx, avg(cells) AS cz FROM passed GROUP BY state)
    SELECT state, units, {D.q6('cx')} AS x_centroid, {D.q6('cz')} AS z_centroid, {D.q6('quantile_cont(x, 0.025)')} AS x_low, {D.q6('quantile_cont(z, 0.025)')} AS z_low, {D.q6('quantile_cont(x, 0.975)')} AS x_high, {D.q6('quantile_cont(z, 0.975)')} AS z_high,
      {D.q6('covar_samp(x, x)')} AS cov_x_x, {D.q6('covar_samp(x, z)')} AS cov_x_z, {D.q6('covar_samp(z, z)')} AS cov_z_z FROM c JOIN k USING (state) GROUP BY state, units, cx, cz"""))
def _(b):
    p = b.view("passed").select("state", "target", (F.col("effect") * 100).alias("x"), F.col("cells").cast("double").alias("z"))
    out = st.centroid_covariance(p, ["state"], "target", ["x", "z"], R, 2)
    return r6(out, *[c for c in out.columns if c not in ("state", "units")])


@query("h28_displacement", lambda: with_views("summary", f"""
    , w AS (SELECT target, target % 30 AS stratum, max(effect) FILTER (WHERE state = 'A') AS o, max(effect) FILTER (WHERE state = 'N') AS de FROM summary GROUP BY target), f AS (SELECT * FROM w WHERE o IS NOT NULL AND de IS NOT NULL), {shuffled('f', 'stratum', 'target', 'de', 5)},
    ob AS (SELECT quantile_cont((de - o) / 0.5, 0.5) AS observed FROM f), nl AS (SELECT replicate, quantile_cont((sh.de - f.o) / 0.5, 0.5) AS v FROM sh JOIN f USING (target) GROUP BY replicate)
    SELECT {D.q6('max(observed)')} AS observed, count(*) AS finite_replicates, {D.q6('least(1, 2 * least((1 + count(*) FILTER (WHERE v >= observed - 1e-12)) / (count(*) + 1.0), (1 + count(*) FILTER (WHERE v <= observed + 1e-12)) / (count(*) + 1.0)))')} AS p_value FROM nl, ob"""))
def _(b):
    w = pivot_complete(b.view("summary"), ["target"], "state", ["A", "N"], "effect").withColumn("stratum", F.col("target") % 30)
    return r6(st.displacement(w, "target", "stratum", "effect_A", "effect_N", 0.5, R, 5), "observed", "p_value")


@query("h29_retention", lambda: with_views("passed", """
    , s AS (SELECT state, target, effect * 1.0 AS u, effect * cells / (cells + 6.0::DOUBLE) AS v FROM passed), q AS (SELECT state, quantile_cont(u, 0.1) AS ul, quantile_cont(u, 0.9) AS uh, quantile_cont(v, 0.1) AS vl, quantile_cont(v, 0.9) AS vh FROM s GROUP BY state),
    c AS (SELECT state, CASE WHEN u <= ul THEN 'buffered' WHEN u >= uh THEN 'amplified' ELSE 'intermediate' END AS original_class, CASE WHEN v <= vl THEN 'buffered' WHEN v >= vh THEN 'amplified' ELSE 'intermediate' END AS r, CASE WHEN v <= ul THEN 'buffered' WHEN v >= uh THEN 'amplified' ELSE 'intermediate' END AS f FROM s JOIN q USING (state))
    """ + f"SELECT state, original_class, count(*) AS n, {D.q6('avg((r = original_class)::INT)')} AS rank_retention, {D.q6('avg((f = original_class)::INT)')} AS fixed_retention FROM c GROUP BY state, original_class"))
def _(b):
    s = b.view("passed").select("state", "target", F.col("effect").alias("u"), (F.col("effect") * F.col("cells") / (F.col("cells") + 6.0)).alias("v"))
    return r6(mx.retention(s, "target", "u", "v", by=["state"]), "rank_retention", "fixed_retention")


@query("h30_conditional_label_coverage", lambda: f"""
    WITH p AS (SELECT l_orderkey AS unit, l_linenumber, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS prob, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first_line, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dup FROM lineitem),
    u AS (SELECT unit, any_value(prob) AS t FROM p WHERE l_linenumber = first_line AND dup = 1 GROUP BY unit), s AS (SELECT unit, sum(CASE WHEN prob > t THEN prob ELSE 0 END) AS g, sum(CASE WHEN prob = t THEN prob ELSE 0 END) AS e FROM p JOIN u USING (unit) GROUP BY unit)
    SELECT m AS mass, {D.q6('avg(least(greatest((m - g) / e, 0), 1))')} AS coverage, count(*) AS units FROM s, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE)) v(m) GROUP BY m""")
def _(b):
    from pyspark.sql import Window as W
    w = W.partitionBy("l_orderkey")
    p = b.table("lineitem").select(
        F.col("l_orderkey").alias("unit"), (F.col("l_quantity") / F.sum("l_quantity").over(w)).alias("prob"),
        ((F.col("l_linenumber") == F.min("l_linenumber").over(w)) & (F.count(F.lit(1)).over(W.partitionBy("l_orderkey", "l_linenumber")) == 1)).alias("is_true"))
    return r6(mx.conditional_label_coverage(p, ["unit"], "prob", "is_true", [0.5, 0.8, 0.95]), "coverage")
