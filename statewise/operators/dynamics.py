"""Moment matrices over feature panels: correlation, lag, transition, horizon, modules.

A panel numbers its features in a table and keeps a step as one sparse row; matrices over
it are blocks (``operators/blocks.py``), so neither the driver nor a task holds a
list of all features or a whole matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.functions.ordering import attach_scalar, exact_quantiles, rank_first, reread, unit_index
from statewise.operators import blocks as bl
from statewise.session import cut_lineage

# ---- panels -------------------------------------------------------------------------------

class Panel(NamedTuple):
    """Numbered features and sparse rows over them: index (feature, i), rows (step..., i, x arrays)."""

    index: DataFrame
    size: int
    rows: DataFrame


def numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """Distinct values of one column as (feature, i), and how many."""
    units = cut_lineage(names.toDF("feature").distinct())
    return unit_index(units, ["feature"], out="i").select("feature", F.col("i").cast("int").alias("i")), units.count()


def panel(long: DataFrame, step: Sequence[str], feature: str = "feature", value: str = "x") -> Panel:
    """One sparse row for each step; absent and null values are 0, repeated ones add up."""
    long = reread(long.filter(F.col(feature).isNotNull()))
    index, size = numbered(long.select(F.col(feature).alias("feature")))
    cell = F.struct("i", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))
    packed = long.withColumnRenamed(feature, "feature").join(index, "feature").groupBy(*step).agg(F.collect_list(cell).alias("p"))
    return Panel(index, size, packed.select(*step, F.col("p.i").alias("vi"), F.col("p.x").alias("vx")))


def _names(index: DataFrame, block: str, names: str) -> DataFrame:
    """Feature names of each block of columns, in order."""
    at = F.floor(F.col("i") / bl.SIDE).cast("int")
    listed = F.array_sort(F.collect_list(F.struct("i", "feature")))
    return index.groupBy(at.alias(block)).agg(F.transform(listed, lambda s: s["feature"]).alias(names))


def _named(rows: DataFrame, index: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """(left, right, value) of block rows (r, c, i, value array)."""
    named = rows.join(_names(index, "r", "_l"), "r").join(_names(index, "c", "_r"), "c")
    return named.select(F.get("_l", F.col("i")).alias(left), F.posexplode(value).alias("_j", value), "_r").select(left, F.get("_r", F.col("_j")).alias(right), value)


def _correlation(g: np.ndarray, ls: np.ndarray, rs: np.ndarray) -> np.ndarray:
    n = max(ls[2, 0], 1.0)
    vx, vy = ls[1] - ls[0] * ls[0] / n, rs[1] - rs[0] * rs[0] / n
    ok = (vx > 1e-12)[:, None] & (vy > 1e-12)
    return np.where(ok, (g - np.outer(ls[0], rs[0]) / n) / np.sqrt(np.where(ok, np.outer(vx, vy), 1.0)), 0.0)


def _edges(panel: Panel, rows: DataFrame, right: tuple[str, str], regulators: Sequence | None) -> DataFrame:
    spark = rows.sparkSession
    found = bl.with_stats(*bl.moments(rows, ("vi", "vx"), right, panel.size, panel.size), spark)
    scores = bl.blockwise(found, lambda g, ls, rs: np.abs(_correlation(g, ls, rs)), "score")
    out = _named(scores, panel.index, "regulator", "gene", "score").filter(F.col("regulator") != F.col("gene"))
    return out.filter(F.col("regulator").isin(list(regulators))) if regulators is not None else out


def correlation_edges(long: DataFrame, step: Sequence[str], regulators: Sequence | None = None) -> DataFrame:
    """Absolute Pearson between every regulator and feature over steps."""
    p = panel(long, step)
    return _edges(p, p.rows, ("vi", "vx"), regulators)


def lagged_rows(rows: DataFrame, order: str) -> DataFrame:
    """Consecutive (v, w) rows along a global order without one-task sorting.

    The follower of a step is found by an equi-join on its position.
    """
    placed = cut_lineage(rank_first(rows, [], order, [order], "__p"))
    ahead = placed.select((F.col("__p") - 1).alias("__p"), F.col("vi").alias("wi"), F.col("vx").alias("wx"))
    return placed.join(ahead, "__p").select(order, "vi", "vx", "wi", "wx")


def lagged_correlation(long: DataFrame, order: str, regulators: Sequence | None = None) -> DataFrame:
    """|corr(x_t, y_t+1)| between regulators and features."""
    p = panel(long, [order])
    return _edges(p, lagged_rows(p.rows, order), ("wi", "wx"), regulators)


def transition_blocks(long: DataFrame, order: str, alpha: float = 10.0, tol: float = 1e-11) -> tuple[bl.Blocks, Panel, np.ndarray]:
    """Multi-output ridge of the next on the current vector, in blocks (source x target).

    Also the panel and, for each target, the relative residual of its normal equations.
    """
    p = panel(long, [order])
    spark = long.sparkSession
    xx, xy, xs, ys = bl.paired_moments(lagged_rows(p.rows, order), ("vi", "vx"), ("wi", "wx"), p.size)
    solved, residual, _ = bl.ridge_solve(bl.centred(xx, xs, xs, spark), bl.centred(xy, xs, ys, spark), alpha, tol)
    return solved, p, residual


def transition_operator(long: DataFrame, order: str, alpha: float = 10.0, tol: float = 1e-11) -> DataFrame:
    """(source, target, weight, residual): weight is the coefficient of the source's current value."""
    solved, p, residual = transition_blocks(long, order, alpha, tol)
    spark, side = long.sparkSession, bl.SIDE
    parts = [(k, [float(x) for x in residual[k * side:(k + 1) * side]]) for k in range(bl.count(p.size))]
    none = F.lit(b"").cast("binary")
    cells = bl.blockwise(bl.to_table(solved, spark).select("r", "c", "width", "cells", none.alias("ls"), none.alias("rs")), lambda g, *_: g, "weight")
    listed = _names(p.index, "c", "_r").join(spark.createDataFrame(parts, "c int, off array<double>"), "c")
    out = cells.join(_names(p.index, "r", "_l"), "r").join(listed, "c")
    pair = F.posexplode("weight").alias("_j", "weight")
    out = out.select(F.get("_l", F.col("i")).alias("source"), pair, "_r", "off")
    return out.select("source", F.get("_r", F.col("_j")).alias("target"), "weight", F.get("off", F.col("_j")).alias("residual"))


def transition_edges(long: DataFrame, order: str, alpha: float = 10.0) -> DataFrame:
    op = transition_operator(long, order, alpha).filter("source <> target")
    return op.select(F.col("source").alias("regulator"), F.col("target").alias("gene"), F.abs("weight").alias("score"))


# ---- operators ----------------------------------------------------------------------------

def operator_blocks(edges: DataFrame) -> tuple[bl.Blocks, DataFrame]:
    """(source, target, weight) as blocks, and the index (feature, i) of its nodes."""
    edges = reread(edges.select("source", "target", F.col("weight").cast("double").alias("value")))
    index, n = numbered(edges.select("source").union(edges.select("target")))
    placed = edges.join(index.toDF("source", "i"), "source").join(index.toDF("target", "j"), "target")
    m = bl.from_triplets(placed.select("i", "j", "value"), n, n)
    return bl.Blocks(bl.kept(m.rdd), n, n), index


def stability(w: bl.Blocks, spark, limit: float = 0.99, tol: float = 1e-9, condition: bool = False, block: int = 32, width: int = 256) -> DataFrame:
    """One row: radius of W, its residual, whether it is below ``limit``, whether it converged, and on request the condition number of I - W.

    Both come from block Krylov spaces that are the whole space for small operators and
    are restarted until their residuals are ``tol`` for larger ones. The condition number
    is the root of that of (I - W)'(I - W), so it is good up to 1e7 or so.
    """
    if w.rows == 0:
        radius, extra = bl.Extremes(np.zeros(1), np.zeros(1), True, 0), (1.0, True)
    else:
        striped = bl.stripes(w)
        radius = bl.krylov(lambda v: bl.times(striped, v), w.rows, spark, "modulus", block, width, tol)
        extra = (None, None)
        if condition:
            turned = bl.stripes(bl.transposed(w))
            less = lambda a, b: a if b is None else -b if a is None else a - b
            ahead = lambda v: bl.meet(v, bl.times(striped, v), less)
            both = bl.krylov(lambda v: (lambda u: bl.meet(u, bl.times(turned, u), less))(ahead(v)), w.rows, spark, "both", block, width, tol)
            least = both.values[-1].real
            extra = (float(np.sqrt(both.values[0].real / least)) if least > 0 else float("inf"), both.converged)
    top = float(np.abs(radius.values[0]))
    row = (top, float(radius.residuals[0]), top < limit, radius.converged, *extra)
    return spark.createDataFrame([row], "radius double, residual double, stable boolean, converged boolean, condition double, condition_converged boolean")


def spectral_radius(edges: DataFrame, tol: float = 1e-9, condition: bool = False, block: int = 32, width: int = 256) -> DataFrame:
    """``stability`` of an edge list (source, target, weight)."""
    return stability(operator_blocks(edges)[0], edges.sparkSession, tol=tol, condition=condition, block=block, width=width)


def stabilise(edges: DataFrame, limit: float = 0.95) -> DataFrame:
    """Scale the edges' operator down to the radius limit when it is above it."""
    factor = F.when(F.col("radius") > limit, limit / F.col("radius")).otherwise(1.0)
    return attach_scalar(edges, spectral_radius(edges)).select("source", "target", (F.col("weight") * factor).alias("weight"))


def stabilised(w: bl.Blocks, spark, limit: float) -> bl.Blocks:
    """W scaled down to the radius limit when it is above it."""
    radius = stability(w, spark).first()["radius"]
    out = bl.scaled(w, limit / radius if radius > limit else 1.0)
    return bl.Blocks(bl.kept(out.rdd), w.rows, w.cols)


def finite_horizon(edges: DataFrame, depth: int = 3, limit: float = 0.95, identity: bool = False, inputs: DataFrame | None = None) -> DataFrame:
    """Powers of the stabilised operator by depth: (source, target, weight, depth).

    Without ``inputs``: W^k for k = 1..depth (and I at 0 on request). With ``inputs``
    (node, input, value), a map B: (node, input, weight, depth) of W^k B for k = 0..depth;
    nodes that no edge names pass their input at depth 0 only. Zeros are left out.
    """
    w, index = operator_blocks(edges)
    return block_horizon(w, index, edges.sparkSession, depth, limit, identity, inputs)


def transition_horizon(long: DataFrame, order: str, alpha: float = 10.0, depth: int = 3, limit: float = 0.95) -> DataFrame:
    """Powers of the fitted transition operator; it stays in blocks from the fit to the last product."""
    solved, p, _ = transition_blocks(long, order, alpha)
    return block_horizon(bl.Blocks(bl.kept(solved.rdd), p.size, p.size), p.index, long.sparkSession, depth, limit)


def block_horizon(w: bl.Blocks, index: DataFrame, spark, depth: int, limit: float, identity: bool = False, inputs: DataFrame | None = None) -> DataFrame:
    """``finite_horizon`` of an operator in blocks over the nodes of ``index`` (feature, i)."""
    w = stabilised(w, spark, limit)
    if inputs is None:
        names, right, columns, levels = ("source", "target"), index, w.cols, [(1, w)]
        if identity:
            levels.insert(0, (0, bl.from_triplets(index.select("i", F.col("i").alias("j"), F.lit(1.0).alias("value")), w.rows, w.cols)))
    else:
        inputs = reread(inputs)
        names = ("node", "input")
        right, columns = numbered(inputs.select("input"))
        cells = inputs.join(index.toDF("node", "i"), "node").join(right.toDF("input", "j"), "input")
        levels = [(0, bl.from_triplets(cells.select("i", "j", F.col("value").cast("double").alias("value")), w.rows, columns))]
    for d in range(levels[-1][0] + 1, depth + 1):
        m = bl.multiply(w, levels[-1][1])
        levels.append((d, bl.Blocks(bl.kept(m.rdd), w.rows, columns)))
    out = None
    for d, m in levels:
        part = bl.to_triplets(m, spark).withColumn("depth", F.lit(d))
        out = part if out is None else out.unionByName(part)
    named = out.join(index.toDF(names[0], "i"), "i").join(right.toDF(names[1], "j"), "j").select(*names, F.col("value").alias("weight"), "depth")
    if inputs is not None:
        outside = inputs.join(index.select(F.col("feature").alias("node")), "node", "left_anti").groupBy("node", "input").agg(F.sum("value").cast("double").alias("weight"))
        named = named.unionByName(outside.filter("weight <> 0").withColumn("depth", F.lit(0)))
    return named


def horizon_edges(powers: DataFrame) -> DataFrame:
    keys = [c for c in powers.columns if c not in ("weight", "depth")]
    return powers.groupBy(*keys).agg(F.sum("weight").alias("weight"))


def depth_growth(powers: DataFrame, depths: int) -> DataFrame:
    """Frobenius norm of each power and of the running sum."""
    inc = powers.groupBy("depth").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("increment"))
    reach = powers.withColumn("upto", F.explode(F.sequence(F.greatest(F.col("depth"), F.lit(1)), F.lit(depths))))
    run = reach.groupBy("upto", "source", "target").agg(F.sum("weight").alias("w")).groupBy(F.col("upto").alias("depth")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("cumulative"))
    return run.join(inc, "depth")


def module_spectrum(tensor: DataFrame, unit: str, keep: float = 0.90, radius: float = 0.85, depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """Thresholded module correlation network and its growth by depth."""
    spark = tensor.sparkSession
    p = panel(tensor.select(unit, F.col("module").cast("string").alias("feature"), F.col("score").alias("x")), [unit])
    found = bl.with_stats(*bl.moments(p.rows, ("vi", "vx"), ("vi", "vx"), p.size, p.size), spark)
    corr = cut_lineage(_named(bl.blockwise(found, _correlation, "weight"), p.index, "source", "target", "weight").filter("source <> target"))
    cut = exact_quantiles(corr.filter("source < target").select(F.abs("weight").alias("a")), [], "a", {"threshold": keep})
    kept = cut_lineage(attach_scalar(corr, cut).filter(F.abs("weight") >= F.col("threshold") - 1e-12).select("source", "target", "weight"))
    scaled = attach_scalar(kept, spectral_radius(kept)).select("source", "target", (F.col("weight") * F.when(F.col("radius") > 0, radius / F.col("radius")).otherwise(1.0)).alias("weight"))
    return kept, depth_growth(finite_horizon(scaled, depth, limit=10.0, identity=False), depth)


# modules (truncated SVD)


def fit_modules(triplets: DataFrame, row: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Truncated SVD of the row x feature matrix: (loadings, diagnostics).

    The factorisation is MLlib's distributed one; only the feature x k loadings
    pass the driver. Signs are arbitrary, so report sign-free quantities.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    spark = triplets.sparkSession
    names = sorted(r[0] for r in triplets.select("feature").distinct().collect())
    width = len(names)
    index = F.array_position(F.lit(names), F.col("feature")) - 1 if width <= 512 else None
    if index is None:
        ids = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, fid int")
        indexed = triplets.join(ids, "feature")
    else:
        indexed = triplets.withColumn("fid", index.cast("int"))
    packed = indexed.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("fid", "value"))).alias("p"))
    vectors = packed.select("p").rdd.map(lambda r: Vectors.sparse(width, [(int(x[0]), float(x[1])) for x in r[0]]))
    svd = RowMatrix(vectors).computeSVD(k, computeU=False)
    v, s = svd.V.toArray(), svd.s.toArray()
    rows = [(names[i], c, float(v[i, c])) for i in range(width) for c in range(v.shape[1])]
    loadings = spark.createDataFrame(rows, "feature string, module int, loading double")
    diagnostics = spark.createDataFrame([(c, float(s[c])) for c in range(len(s))], "module int, singular double")
    return loadings, diagnostics


def project(triplets: DataFrame, loadings: DataFrame, row: Sequence[str]) -> DataFrame:
    return triplets.join(loadings, "feature").groupBy(*row, "module").agg(F.sum(F.col("value") * F.col("loading")).alias("score"))


def explained_variance(triplets: DataFrame, scores: DataFrame, row: Sequence[str]) -> DataFrame:
    """Score variance over total feature variance per component (zeros included)."""
    n = triplets.select(*row).distinct().agg(F.count(F.lit(1)).alias("n"))
    var = lambda df, key, v: attach_scalar(df.groupBy(key).agg(F.sum(v).alias("s"), F.sum(F.col(v) * F.col(v)).alias("ss")), n).select(
        key, (F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2))).alias("variance"))
    total = var(triplets, "feature", "value").agg(F.sum("variance").alias("total"))
    return attach_scalar(var(scores, "module", "score"), total).select("module", (F.col("variance") / F.col("total")).alias("explained"))


def cross_fitted_modules(triplets: DataFrame, row: Sequence[str], fold: str, folds: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Fit on the other folds, project the held-out rows; returns (projection
    cosine per row = |score| / |row|, scores)."""
    scores = None
    for f in range(folds):
        loadings, _ = fit_modules(triplets.filter(F.col(fold) != f), row, k)
        part = project(triplets.filter(F.col(fold) == f), loadings, row).withColumn(fold, F.lit(f))
        scores = part if scores is None else scores.unionByName(part)
    norms = triplets.groupBy(*row, fold).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    lengths = scores.groupBy(*row).agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("length"))
    return norms.join(lengths, list(row), "left").select(*row, fold, F.coalesce(F.try_divide("length", "norm"), F.lit(0.0)).alias("projection_cosine")), scores


def remove_nuisance(triplets: DataFrame, covariates: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """Per-row squared norm left after projecting out the response subspace of
    the covariates: (row, norm2, projected, remaining).

    X'Z comes from one join; the k x k Gram is orthogonalised in one small task.
    """
    stats = covariates.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    z = attach_scalar(covariates, stats)
    scaled = [F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0), F.lit(0.0)) for c in columns]
    z = z.select(row, F.array(F.lit(1.0), *scaled).alias("z"))
    k = len(columns) + 1
    pick = lambda a, i: F.col(a)[i]
    zz = z.agg(F.array(*[F.sum(pick("z", i) * pick("z", j)) for i in range(k) for j in range(k)]).alias("zz"))
    xz = triplets.join(z, row).groupBy("feature").agg(F.array(*[F.sum(F.col("value") * pick("z", i)) for i in range(k)]).alias("b"))
    gram = attach_scalar(xz.agg(F.array(*[F.sum(pick("b", i) * pick("b", j)) for i in range(k) for j in range(k)]).alias("bb")), zz)

    def basis(frames):
        for f in frames:
            for r in f.itertuples():
                inv = np.linalg.pinv(np.asarray(r.zz).reshape(k, k), rcond=1e-10)
                # beta = inv B'; orthonormal row basis of beta from its k x k Gram
                g = inv @ np.asarray(r.bb).reshape(k, k) @ inv.T
                values, vectors = np.linalg.eigh((g + g.T) / 2)
                good = values > max(values.max(), 1e-24) * 1e-12
                t = (vectors[:, good] / np.sqrt(values[good])).T @ inv
                t = np.vstack([t, np.zeros((k - t.shape[0], k))])
                yield pd.DataFrame({"t": [t.ravel()]})

    t = gram.mapInPandas(basis, "t array<double>")
    q = attach_scalar(xz, t).select("feature", F.array(*[
        sum((pick("t", i * k + j) * pick("b", j) for j in range(1, k)), pick("t", i * k) * pick("b", 0)) for i in range(k)]).alias("q"))
    p = triplets.join(q, "feature").groupBy(row).agg(F.sum(F.col("value") * F.col("value")).alias("norm2"), *[F.sum(F.col("value") * pick("q", i)).alias(f"p{i}") for i in range(k)])
    projected = sum((F.col(f"p{i}") * F.col(f"p{i}") for i in range(1, k)), F.col("p0") * F.col("p0"))
    return p.select(row, "norm2", projected.alias("projected"), F.greatest(F.col("norm2") - projected, F.lit(0.0)).alias("remaining"))
