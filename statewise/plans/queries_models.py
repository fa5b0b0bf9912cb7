"""Cross-fitted model queries over the given tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from statewise.functions.scalars import hash_fold, transfer_features
from statewise.operators import contracts as ct
from statewise.operators import groups as gr
from statewise.operators import models as md
from statewise.operators.metrics import regression_metrics
from statewise.plans.bindings import DUCK, q6
from statewise.plans.queries_groups import r6
from statewise.plans.registry import query, with_views

D = DUCK
NUM = ["cis_magnitude", "log1p_base_mean", "log1p_cells", "guides"]


def _table(b, folds=3):
    p = transfer_features(ct.quality_filter(b.view("summary"), 2, 3))
    return p.withColumns({"fold": (hash_fold(F.col("target"), folds, base=0)).cast("int"), "guides": F.col("guides").cast("double")})


@query("j1_cross_fit")
def _(b):
    make = lambda train: Pipeline(stages=[*md.preprocess(NUM, ["state"]), md.ridge_stage(train, "log1p_downstream", 1.0)])
    return md.cross_fit(_table(b), "fold", [0, 1, 2], make, ["target", "state"]).select("target", "state", "fold", "log1p_downstream", "prediction")


@query("j2_preprocess")
def _(b):
    return md.preprocessed(_table(b), "fold", range(3), lambda: md.preprocess(NUM, ["state"]), ["target", "state"])


PAIR = "t AS (SELECT p_partkey, p_brand, p_size::DOUBLE AS x, ln(p_retailprice) * 100 AS y FROM part)"


def _pair(b):
    return b.table("part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x"), (F.log("p_retailprice") * 100).alias("y"), F.lit(1).alias("one"))


RIDGE_SQL = """{head}, k AS (SELECT *, {fold} AS fold FROM t), rf AS (SELECT fs AS fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy FROM k, (SELECT DISTINCT fold AS fs FROM k) z WHERE k.fold <> fs GROUP BY fs),
    p AS (SELECT k.*, my + (x - mx) * (n * cxy) / (n * vx + {alpha} * vx) AS prediction FROM k JOIN rf USING (fold))"""


@query("j3_ridge_cross_fit", lambda: RIDGE_SQL.format(head="WITH " + PAIR, fold=D.fold("p_partkey", 5), alpha="10.0") + f" SELECT p_partkey, fold, {D.q6('prediction')} AS prediction FROM p")
def _(b):
    t = _pair(b).withColumn("fold", hash_fold(F.col("p_partkey"), 5, base=0))
    return r6(md.ridge_cross_fit(t, "fold", ["x"], "y", 10.0).select("p_partkey", "fold", "prediction"), "prediction")


@query("j3_ridge_pipeline", lambda: f"WITH {PAIR}, m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy FROM t) SELECT p_partkey, {D.q6('my + (x - mx) * (n * cxy) / (n * vx + 25.0)', 5)} AS prediction FROM t, m")
def _(b):
    from pyspark.ml.feature import VectorAssembler
    t = _pair(b)
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), md.ridge_stage(t, "y", 25.0)]).fit(t)
    return model.transform(t).select("p_partkey", q6("prediction", 5).alias("prediction"))


GRID = ([0.001, 0.01, 0.05, 0.2, 1.0], [0.1, 0.5, 0.9, 1.0])


def _nested(b):
    return md.nested_elastic_net(_table(b, 10), "fold", NUM, "log1p_downstream", *GRID, ["target", "state"], range(10))


@query("j3_elastic_net_choice", lambda: with_views("passed", f" SELECT DISTINCT {D.fold('target', 10)}::INT AS fold, TRUE AS optimal, TRUE AS on_grid, 9::BIGINT AS inner_folds, 180::BIGINT AS inner_models FROM passed"))
def _(b):
    """Optimality of the chosen model of every held-out fold, and the inner models behind the choice."""
    _, choices, inner = _nested(b)
    tried = inner.groupBy("fold").agg(F.count_distinct("inner_fold").alias("inner_folds"), F.count(F.lit(1)).alias("inner_models"), F.collect_set(F.struct("alpha", "l1_ratio")).alias("grid"))
    on_grid = F.array_contains("grid", F.struct("alpha", "l1_ratio"))
    return choices.join(tried, "fold").select("fold", (F.col("optimality") < 1e-8).alias("optimal"), on_grid.alias("on_grid"), "inner_folds", "inner_models")


@query("j3_elastic_net_predictions")
def _(b):
    return _nested(b)[0]


@query("j4_huber")
def _(b):
    make = lambda train: Pipeline(stages=[*md.preprocess(NUM), md.huber_stage("log1p_downstream")])
    return md.cross_fit(_table(b, 2), "fold", [0, 1], make, ["target", "state"]).select("target", "state", "log1p_downstream", "prediction")


@query("j5_boosted_trees")
def _(b):
    make = lambda train: Pipeline(stages=[*md.preprocess(NUM, ["state"]), md.boosted_stage("log1p_downstream", 10)])
    preds = md.cross_fit(_table(b, 2), "fold", [0, 1], make, ["target", "state"])
    return regression_metrics(preds, ["fold"], "log1p_downstream", "prediction")


@query("j6_balanced_logistic")
def _(b):
    s = b.view("scored").withColumn("fold", (hash_fold(F.col("unit"), 2, base=0)).cast("int"))
    return md.logistic_cross_fit(s, "fold", [0, 1], ["score_a", "score_b"], ["dataset"], "y", ["unit"])


POOL = f""", t AS (SELECT target, state, ln(1 + downstream) AS y, {D.fold('target', 10)} + 1 AS fold FROM passed), c AS (SELECT fold, state, sum(y) AS s, count(*) AS c FROM t GROUP BY ALL),
    e AS (SELECT a.fold, a.state, (sum(y) FILTER (WHERE t.state = a.state) + 20 * avg(y)) / (count(*) FILTER (WHERE t.state = a.state) + 20) AS expected FROM c a JOIN t ON t.fold <> a.fold GROUP BY ALL),
    r AS (SELECT t.*, expected, y - expected AS residual FROM t JOIN e USING (fold, state)), z AS (SELECT *, {D.q6('residual / stddev_samp(residual) OVER (PARTITION BY state)')} AS z FROM r), q AS (SELECT quantile_cont(z, 0.1) AS lo, quantile_cont(z, 0.9) AS hi FROM z),
    k AS (SELECT *, CASE WHEN z <= lo THEN 'buffered' WHEN z >= hi THEN 'amplified' ELSE 'intermediate' END AS transfer_class FROM z, q)"""


def _flagship(b):
    p = ct.quality_filter(b.view("summary"), 2, 3)
    t = p.select("target", "state", F.log1p(F.col("downstream").cast("double")).alias("y"), hash_fold(F.col("target"), 10).alias("fold"))
    return md.transfer_phenotypes(md.state_pool(t, "fold", "state", "y", 20.0), "state", "y", places=6)


@query("j7_state_pool_transfer", lambda: with_views("passed", POOL + " SELECT state, transfer_class, count(*) AS n, " + D.q6("avg(z)") + " AS mean_z, min(z) AS min_z, max(z) AS max_z FROM k GROUP BY state, transfer_class"))
def _(b):
    """Flagship: residual phenotype classes per state."""
    g = _flagship(b).groupBy("state", "transfer_class").agg(
        F.count(F.lit(1)).alias("n"), q6(F.avg("transfer_z")).alias("mean_z"), F.min("transfer_z").alias("min_z"), F.max("transfer_z").alias("max_z"))
    return g


@query("j7_state_pool_rows", lambda: with_views("passed", POOL + f" SELECT target, state, fold, {D.q6('expected')} AS expected, {D.q6('residual')} AS residual, z AS transfer_z, transfer_class FROM k"))
def _(b):
    return r6(_flagship(b).select("target", "state", "fold", "expected", "residual", "transfer_z", "transfer_class"), "expected", "residual")


@query("j8_graph_readout")
def _(b):
    x = b.table("supplier").select(F.col("s_suppkey").alias("node"), F.lit("acctbal").alias("column"), (F.col("s_acctbal") / 1000).alias("value"))
    e = b.view("edges").filter("direction = 1").groupBy("source", (F.col("response") % 100).alias("target")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    y = b.view("effects").groupBy(F.col("target").alias("node")).agg(F.sum("value").alias("y"))
    y = y.withColumn("fold", hash_fold(F.col("node"), 3, base=0))
    return md.graph_readout(x, e, y, "fold", "y", 1.0).select("node", "fold", "y", "prediction")


def _guides(b):
    """Pairs of lines of an order stand in for guide pairs of a target."""
    t = b.table("lineitem")
    two = t.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("l_linenumber").alias("d")).filter("c = 2 AND d = 2").select("l_orderkey")
    return t.join(two, "l_orderkey", "left_semi").select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("guide"), (F.col("l_quantity") / 50).alias("dose"), F.log1p("l_extendedprice").alias("y"), "l_discount", "l_tax",
        hash_fold(F.col("l_orderkey"), 3, base=0).alias("fold"))


DOSE = f"""WITH d AS (SELECT l_orderkey AS pair_id, l_linenumber AS guide, l_quantity / 50 AS dose, ln(1 + l_extendedprice) AS y, {D.fold('l_orderkey', 3)} AS fold FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 2 AND min(l_linenumber) OVER (PARTITION BY l_orderkey) <> max(l_linenumber) OVER (PARTITION BY l_orderkey)),
    c AS (SELECT *, dose - avg(dose) OVER (PARTITION BY pair_id) AS cx, y - avg(y) OVER (PARTITION BY pair_id) AS cy FROM d), b AS (SELECT h AS fold, sum(cx * cy) / (sum(cx * cx) + 1e-6) AS beta FROM c, range(3) x(h) WHERE fold <> h GROUP BY h)"""


@query("j9_dose_linear", lambda: DOSE + f" SELECT a.pair_id, a.fold AS heldout, a.guide, 'linear' AS family, {D.q6('a.y')} AS observed, {D.q6('z.y + beta * (a.dose - z.dose)')} AS predicted FROM d a JOIN d z ON a.pair_id = z.pair_id AND a.guide <> z.guide JOIN b ON b.fold = a.fold")
def _(b):
    out = md.dose_response(_guides(b), [], "fold", "pair_id", "guide", "dose", "y", [], ["linear"])
    return r6(out.select("pair_id", "heldout", "guide", "family", "observed", "predicted"), "observed", "predicted")


@query("j9_dose_families")
def _(b):
    out = md.dose_response(_guides(b), [], "fold", "pair_id", "guide", "dose", "y", ["l_discount", "l_tax"])
    return regression_metrics(out, ["family", "heldout"], "observed", "predicted", spearman=False)


def _compared(b):
    t = _pair(b).withColumn("fold", hash_fold(F.col("p_partkey"), 5, base=0))
    ridge = md.ridge_cross_fit(t, "fold", ["x"], "y", 10.0).select("p_partkey", "fold", "y", "prediction", F.lit("ridge").alias("model"))
    pool = md.state_pool(t, "fold", "p_brand", "y", 20.0).select("p_partkey", "fold", "y", F.col("expected").alias("prediction"), F.lit("pool").alias("model"))
    mean = md.state_pool(t, "fold", "p_brand", "y", 20.0).select("p_partkey", "fold", "y", F.col("global_mean").alias("prediction"), F.lit("mean").alias("model"))
    return ridge.unionByName(pool).unionByName(mean)


COMPARE = RIDGE_SQL.format(head="WITH " + PAIR, fold=D.fold("p_partkey", 5), alpha="10.0") + """,
    e AS (SELECT z.fold, z.p_brand, avg(k.y) AS g, (coalesce(sum(k.y) FILTER (WHERE k.p_brand = z.p_brand), 0) + 20 * avg(k.y)) / (count(*) FILTER (WHERE k.p_brand = z.p_brand) + 20) AS pl FROM (SELECT DISTINCT fold, p_brand FROM k) z JOIN k ON k.fold <> z.fold GROUP BY ALL),
    a AS (SELECT p_partkey, fold, y, prediction, 'ridge' AS model FROM p UNION ALL SELECT p_partkey, k.fold, y, pl, 'pool' FROM k JOIN e USING (fold, p_brand) UNION ALL SELECT p_partkey, k.fold, y, g, 'mean' FROM k JOIN e USING (fold, p_brand))"""


@query("j10_model_comparison", lambda: COMPARE + f""", m AS (SELECT model, count(*) AS n, 1 - sum(pow(y - prediction, 2)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - prediction)) AS mae, sqrt(avg(pow(y - prediction, 2))) AS rmse FROM a GROUP BY model),
    f AS (SELECT model, avg(r2) AS mf, stddev_samp(r2) / sqrt(count(*)) AS sf FROM (SELECT model, fold, 1 - sum(pow(y - prediction, 2)) / (var_pop(y) * count(*)) AS r2 FROM a GROUP BY ALL) GROUP BY model)
    SELECT model, n, {D.q6('r2')} AS r2, {D.q6('mae')} AS mae, {D.q6('rmse')} AS rmse, {D.q6('mf')} AS mean_fold_r2, {D.q6('sf')} AS se_fold_r2, {D.q6("r2 - (SELECT r2 FROM m WHERE model = 'mean')")} AS r2_gain FROM m JOIN f USING (model)""")
def _(b):
    out = md.model_comparison(_compared(b), "model", "fold", ["p_partkey"], "y", "prediction", "mean").drop("z", "p_value", "q")
    return r6(out, "r2", "mae", "rmse", "mean_fold_r2", "se_fold_r2", "r2_gain")


@query("j10_model_error_tests")
def _(b):
    return md.model_comparison(_compared(b), "model", "fold", ["p_partkey"], "y", "prediction", "mean").select("model", "r2_gain", "z", "p_value", "q")


@query("j11_ablate")
def _(b):
    return md.ablate(_table(b), "fold", NUM, "log1p_downstream", 1.0, {"cis": ["cis_magnitude"], "size": ["log1p_cells", "guides"], "base": ["log1p_base_mean"]})


@query("j12_one_se_selection", lambda: COMPARE + f""", r AS (SELECT model, fold, 1 - sum(pow(y - prediction, 2)) / (var_pop(y) * count(*)) AS r2 FROM a GROUP BY ALL), s AS (SELECT model, avg(r2) AS m, stddev_samp(r2) / sqrt(count(*)) AS se FROM r GROUP BY model), tb AS (SELECT model AS best_model, m - se AS cut FROM s ORDER BY m DESC, model LIMIT 1)
    SELECT model, {D.q6('m')} AS mean_metric, {D.q6('se')} AS se_metric, best_model, m >= cut AS within_one_se FROM s, tb""")
def _(b):
    per = regression_metrics(_compared(b), ["model", "fold"], "y", "prediction", spearman=False)
    return r6(md.one_se_selection(per, [], "model", "r2"), "mean_metric", "se_metric")


@query("j13_cross_fitted_transfer")
def _(b):
    out = md.cross_fitted_transfer(ct.quality_filter(b.view("summary"), 2, 3).withColumn("fold", (hash_fold(F.col("target"), 2, base=0)).cast("int")), "fold", [0, 1], ["target", "state"], 10)
    return out.select("target", "state", "fold", "expected", "residual", "transfer_z", "transfer_class")


@query("j14_applicability")
def _(b):
    t = _table(b, 2)
    base = md.state_pool(t, "fold", "state", "log1p_downstream", 20.0)
    e = base.select("target", "state", "fold", *NUM, F.abs(F.col("log1p_downstream") - F.col("expected")).alias("error"), (hash_fold(F.concat(F.col("target"), F.lit("|calibration")), 3, base=0)).cast("int").alias("inner"))
    return md.applicability(e, NUM, "error", ["target", "state"], "fold", [0, 1], "inner", [0.01], [0.0, 0.5])[0]
