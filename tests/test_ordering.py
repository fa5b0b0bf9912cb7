"""The bucketed forms must equal the plain windows, also with tiny buckets and heavy ties."""

import random

import pytest
from pyspark.sql import functions as F

from statewise.functions import ordering as o


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for g, n in (("hot", 900), ("small", 7), ("one", 1)):
        for i in range(n):
            v = None if rng.random() < 0.05 else (0.0 if rng.random() < 0.3 else round(rng.uniform(-5, 5), 1))
            data.append((g, i, v))
    return spark.createDataFrame(data, "g string, k int, v double").cache()


@pytest.fixture(autouse=True)
def plain_unless_limited(monkeypatch):
    monkeypatch.setattr(o, "fits_one_task", lambda df, limit=o.ROWS_PER_BUCKET: limit == o.ROWS_PER_BUCKET)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_rank_first(rows):
    plain = as_set(o.rank_first(rows, ["g"], "v", ["k"], "r", "n"))
    cut = as_set(o.rank_first(rows, ["g"], "v", ["k"], "r", "n", limit=20))
    assert plain == cut


def test_prefix_and_running(rows, monkeypatch):
    ties = rows.filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"), F.max("k").alias("m"))
    assert as_set(o.prefix_sums(ties, ["g"], "v", ["c"])) == as_set(o.prefix_sums(ties, ["g"], "v", ["c"], limit=5))
    for largest in (True, False):
        for down in (True, False):
            plain = o.running_extreme(ties, ["g"], "v", {"m": "x"}, largest, down)
            cut = o.running_extreme(ties, ["g"], "v", {"m": "x"}, largest, down, limit=5)
            assert as_set(plain) == as_set(cut)


def test_quantiles(rows):
    probs = {"a": 0.1, "b": 0.5, "c": 0.975}
    plain = sorted(as_set(o.exact_quantiles(rows, ["g"], "v", probs)), key=str)
    cut = sorted(as_set(o.exact_quantiles(rows, ["g"], "v", probs, limit=5)), key=str)
    for x, y in zip(plain, cut):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:], abs=1e-12)
    assert len(plain) == len(cut)


def test_rank_average(rows, monkeypatch):
    plain = as_set(o.rank_average(rows, ["g"], "v", "r"))
    monkeypatch.setattr(o, "settled", lambda df, limit=0: (df, False))
    monkeypatch.setattr(o, "_cut", lambda df, by, value, limit, cut=o._cut: cut(df, by, value, 5))
    assert plain == as_set(o.rank_average(rows, ["g"], "v", "r"))


def test_unit_index(rows):
    units = rows.select("g", "k")
    got = o.unit_index(units, ["k"], ["g"]).collect()
    for g, n in (("hot", 900), ("small", 7), ("one", 1)):
        assert sorted(r["idx"] for r in got if r["g"] == g) == list(range(n))
        assert {r["n_units"] for r in got if r["g"] == g} == {n}
    small = o.unit_index(units.repartition(13), ["k"], ["g"]).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in small}
