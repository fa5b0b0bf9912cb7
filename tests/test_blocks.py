"""Block matrices against numpy, with blocks small enough that every path is taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewise.operators import blocks as bl
from statewise.operators import dynamics as dy


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(bl, "SIDE", 7)
    monkeypatch.setattr(bl, "GROUP", 2)
    monkeypatch.setattr(bl, "STRIPE_BLOCKS", 2)
    monkeypatch.setattr(bl, "MOMENT_BYTES", 8 * 7 * 20)
    monkeypatch.setattr(bl, "CHUNK_CELLS", 64)


def triplets(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i int, j int, value double")


def whole(m):
    out = np.zeros((m.rows, m.cols))
    for (r, c), x in m.rdd.collect():
        x = bl.dense(x)
        out[r * bl.SIDE:r * bl.SIDE + x.shape[0], c * bl.SIDE:c * bl.SIDE + x.shape[1]] += x
    return out


def edges_of(spark, a):
    return triplets(spark, a).toDF("source", "target", "weight")


def test_products_and_rows_come_back(spark, small_blocks):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((23, 30)) * (rng.random((23, 30)) < 0.1), rng.standard_normal((30, 11))
    x, y = bl.from_triplets(triplets(spark, a), 23, 30), bl.from_triplets(triplets(spark, b), 30, 11)
    assert np.allclose(whole(bl.multiply(x, y)), a @ b) and np.allclose(whole(bl.transposed(x)), a.T)
    got = {(r.i, r.j): r.value for r in bl.to_triplets(bl.scaled(x, 2.0), spark).collect()}
    assert got == pytest.approx({(int(i), int(j)): 2 * a[i, j] for i, j in zip(*np.nonzero(a))})
    assert bl.to_triplets(x, spark, zeros=True).filter("value = 0").count() >= 0


def long_of(spark, x):
    return spark.createDataFrame([(t, f"f{j:04}", float(x[t, j])) for t in range(len(x)) for j in range(x.shape[1]) if x[t, j]], "step long, feature string, x double")


def test_panels_equal_numpy(spark, small_blocks):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 25)) * (rng.random((40, 25)) < 0.7)
    x[:, 3] = 2.0
    long = long_of(spark, x)
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.abs(np.nan_to_num(np.corrcoef(x, rowvar=False)))
        lag = np.abs(np.nan_to_num(np.corrcoef(x[:-1], x[1:], rowvar=False)[:25, 25:]))
    want[3, :] = want[:, 3] = lag[3, :] = lag[:, 3] = 0
    name = lambda f: int(f[1:])
    got = dy.correlation_edges(long, ["step"]).collect()
    assert len(got) == 25 * 24 and all(abs(r.score - want[name(r.regulator), name(r.gene)]) < 1e-9 for r in got)
    got = dy.lagged_correlation(long, "step", ["f0001", "f0009"]).collect()
    assert len(got) == 2 * 24 and all(abs(r.score - lag[name(r.regulator), name(r.gene)]) < 1e-9 for r in got)


def test_ridge_equals_numpy(spark, small_blocks):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 20))
    x[:, 5] = 0.999 * x[:, 4] + 0.001 * x[:, 6]
    a, b = x[:-1] - x[:-1].mean(axis=0), x[1:] - x[1:].mean(axis=0)
    want = np.linalg.solve(a.T @ a + 0.5 * np.eye(20), a.T @ b)
    got = dy.transition_operator(long_of(spark, x), "step", 0.5).collect()
    assert len(got) == 400 and max(r.residual for r in got) < 1e-10
    assert all(abs(r.weight - want[int(r.source[1:]), int(r.target[1:])]) < 1e-7 for r in got)


def clustered(rng, n):
    """A non-normal operator with a tight cluster at the top and complex pairs."""
    values = np.concatenate([[0.9, 0.8999, 0.8998], rng.uniform(-0.4, 0.4, n - 7)])
    core = np.diag(np.concatenate([values, np.zeros(4)]))
    for k, (radius, angle) in enumerate([(0.89, 1.0), (0.3, 2.0)]):
        c, s = radius * np.cos(angle), radius * np.sin(angle)
        at = n - 4 + 2 * k
        core[at:at + 2, at:at + 2] = [[c, -s], [s, c]]
    mix = rng.standard_normal((n, n)) / np.sqrt(n) + 2 * np.eye(n)
    return mix @ core @ np.linalg.inv(mix)


def rotation(rng, n):
    """Complex leading pair only."""
    a = rng.standard_normal((n, n)) * 0.3 / np.sqrt(n)
    a[:2, :2] += [[0.0, -1.2], [1.2, 0.0]]
    return a


@pytest.mark.parametrize(("make", "n", "block", "width"), [(clustered, 60, 8, 40), (rotation, 60, 4, 20), (clustered, 30, 32, 256), (rotation, 25, 8, 64)])
def test_radius_and_condition_equal_numpy(spark, small_blocks, make, n, block, width):
    """Restarted spaces, spaces that fill up, and single blocks give the same numbers."""
    a = make(np.random.default_rng(n), n)
    r = dy.spectral_radius(edges_of(spark, a), tol=1e-8, condition=block >= 8 and width > 40, block=block, width=width).first()
    assert r.converged and r.radius == pytest.approx(np.abs(np.linalg.eigvals(a)).max(), rel=1e-6)
    if r.condition is not None:
        assert r.condition_converged and r.condition == pytest.approx(np.linalg.cond(np.eye(n) - a), rel=1e-5)


def test_zero_and_nilpotent_operators(spark):
    a = np.zeros((5, 5))
    a[0, 1] = a[1, 2] = a[2, 3] = 1.0
    r = dy.spectral_radius(edges_of(spark, a), condition=True).first()
    assert (r.radius < 1e-4, r.stable, r.converged) == (True, True, True) and r.condition == pytest.approx(np.linalg.cond(np.eye(4) - a[:4, :4]), rel=1e-9)
    none = spark.createDataFrame([], "source int, target int, weight double")
    assert dy.spectral_radius(none, condition=True).first().radius == 0.0
    assert dy.finite_horizon(none).count() == 0


def test_input_map_follows_the_definition(spark, small_blocks):
    rng = np.random.default_rng(5)
    w = rng.standard_normal((20, 20)) * (rng.random((20, 20)) < 0.3)
    b = rng.standard_normal((22, 3))
    radius = np.abs(np.linalg.eigvals(w)).max()
    stable = w * min(1.0, 0.9 / radius)
    inputs = triplets(spark, b).toDF("node", "input", "value")
    got = dy.finite_horizon(edges_of(spark, w), 4, 0.9, inputs=inputs)
    nodes = sorted({*np.nonzero(w)[0], *np.nonzero(w)[1]})
    assert len(nodes) == 20
    want, current = {0: b[:20]}, b[:20]
    for d in range(1, 5):
        current = stable @ current
        want[d] = current
    for r in got.collect():
        known = want[r.depth][r.node, r.input] if r.node < 20 else b[r.node, r.input]
        assert r.weight == pytest.approx(known, rel=1e-6, abs=1e-9) and (r.node < 20 or r.depth == 0)
    plain = dy.finite_horizon(edges_of(spark, w), 2, 0.9, identity=True).groupBy("depth").agg(F.sum("weight").alias("s")).collect()
    assert {r.depth: r.s for r in plain} == pytest.approx({0: 20.0, 1: stable.sum(), 2: (stable @ stable).sum()}, rel=1e-6)


def test_wide_panel(spark):
    """6,000 features: 24 x 24 blocks in several slabs, no list of them anywhere."""
    steps, n = 12, 6000
    cell = F.when((F.col("step") * 31 + F.col("j") * 17) % 5 > 0, F.sin(F.col("step") * 1.7 + F.col("j") * F.col("j") * 0.001))
    long = spark.range(steps).withColumnRenamed("id", "step").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("step", F.col("j").alias("feature"), cell.alias("x"))
    t, j = np.meshgrid(np.arange(steps), np.arange(n), indexing="ij")
    x = np.where((t * 31 + j * 17) % 5 > 0, np.sin(t * 1.7 + j * j * 0.001), 0.0)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.abs(x.T @ x / steps)
    got = dy.correlation_edges(long, ["step"]).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.max("score").alias("top")).first()
    assert got.n == n * (n - 1) and got.s == pytest.approx(want.sum() - np.trace(want), rel=1e-9) and got.top <= 1 + 1e-9
