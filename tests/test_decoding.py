"""State decoding against numpy: zero vectors, both ways of scoring, nested temperature."""

import numpy as np
import pytest

from statewise.operators import vectors as vx

STATES, BETAS = ("A", "N", "R"), [0.5, 4.0, 30.0]


@pytest.fixture(scope="module")
def cube():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3, 12, 15)) * (rng.random((3, 12, 15)) < 0.2)
    x[1:] += 0.8 * x[0]
    x[0, 3] = x[1, 5] = x[2, 7] = 0.0
    x[:, 9] = 0.0
    return x


def long_of(spark, cube):
    return spark.createDataFrame([(s, i, f"f{j}", float(cube[k, i, j])) for k, s in enumerate(STATES) for i in range(12) for j in range(15) if cube[k, i, j]], "state string, unit int, feature string, value double")


def scores(q, c, model="cosine", scale=1.0):
    if model == "cosine":
        n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))
        return np.divide(q @ c.T, n, out=np.zeros((len(q), len(c))), where=n > 0)
    return -((q[:, None] - c[None]) ** 2).sum(-1) / scale


def decoded(s, beta):
    z = np.log(np.exp(beta * s).sum(1))
    ties = s >= s.max(1, keepdims=True) - 1e-14
    own = np.diag(s)
    return {i: (own[i], beta * own[i] - z[i], ties[i, i] / ties[i].sum()) for i in range(len(s))}


@pytest.mark.parametrize(("model", "scoring", "block"), [("cosine", "index", 1024), ("cosine", "blocks", 5), ("cosine", None, 1024), ("distance", None, 5)])
def test_every_unit_is_decoded(spark, cube, model, scoring, block):
    long, units = long_of(spark, cube), spark.range(12).selectExpr("cast(id as int) as unit")
    part = lambda s: long.filter(long.state == s).select("unit", "feature", "value")
    got = vx.decode_states(part("A"), part("N"), "unit", BETAS, model, 2.0, block, units, scoring=scoring).collect()
    assert len(got) == 12 * len(BETAS) and {r.classes for r in got} == {12}
    for beta in BETAS:
        want = decoded(scores(cube[0], cube[1], model, 2.0), beta)
        for r in got:
            if r.beta == beta:
                assert (r.true_score, r.log_probability, r.fractional_top1) == pytest.approx(want[r.unit], abs=1e-9)
                assert r.information == pytest.approx(np.log(12) + want[r.unit][1], abs=1e-9)


def test_temperature_is_chosen_on_the_other_states(spark, cube):
    units = spark.range(12).selectExpr("cast(id as int) as unit")
    losses, out = vx.nested_decode(long_of(spark, cube), "unit", "state", STATES, BETAS, units)
    seen = {(r.heldout_state, r.inner_training_state, r.inner_validation_state, r.beta): (r.log_loss, r.targets) for r in losses.collect()}
    assert len(seen) == 6 * len(BETAS)
    rows = out.collect()
    for h, held in enumerate(STATES):
        a, b = (k for k in range(3) if k != h)
        mean = []
        for beta in BETAS:
            loss = [-np.mean([v[1] for v in decoded(scores(cube[v], cube[t]), beta).values()]) for t, v in ((a, b), (b, a))]
            assert seen[held, STATES[a], STATES[b], beta] == (pytest.approx(loss[0]), 12) and seen[held, STATES[b], STATES[a], beta] == (pytest.approx(loss[1]), 12)
            mean.append(np.mean(loss))
        best = BETAS[int(np.argmin(mean))]
        want = decoded(scores(cube[h], (cube[a] + cube[b]) / 2), best)
        mine = [r for r in rows if r.heldout_state == held]
        assert len(mine) == 12 and {r.beta for r in mine} == {best}
        assert all((r.true_score, r.log_probability, r.fractional_top1) == pytest.approx(want[r.unit], abs=1e-9) for r in mine)


def test_hits_are_not_shuffled_when_most_pairs_share_a_feature(spark, monkeypatch):
    """Forty features over 300 units: the index would make a row for each pair and feature."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2, 300, 40)) * (rng.random((2, 300, 40)) < 0.1)
    rows = [[(i, f"f{j}", float(x[s, i, j])) for i in range(300) for j in range(40) if x[s, i, j]] for s in (0, 1)]
    q, c = (spark.createDataFrame(r, "unit int, feature string, value double") for r in rows)
    monkeypatch.setattr(vx, "_index_scores", None)
    monkeypatch.setattr(vx, "SCORED", 64)
    got = vx.decode_states(q, c, "unit", BETAS, block=128, units=spark.range(300).selectExpr("cast(id as int) as unit")).collect()
    for beta in BETAS:
        want = decoded(scores(x[0], x[1]), beta)
        assert all((r.true_score, r.log_probability, r.fractional_top1) == pytest.approx(want[r.unit], abs=1e-9) for r in got if r.beta == beta)


@pytest.mark.parametrize("wide", [1 << 16, 40])
def test_rows_are_repeated_for_a_few_groups_only(spark, monkeypatch, wide):
    """F6, F8: a class is shuffled once for each group of units, not once for each block of 8; a wider limit only bounds a group."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2, 300, 6))
    rows = [[(t, i, f"f{j}", float(x[s, i, j] * (1 + t * j))) for t in (0, 1) for i in range(300) for j in range(6)] for s in (0, 1)]
    q, c = (spark.createDataFrame(r, "task int, unit int, feature string, value double") for r in rows)
    frame, seen = type(q), []
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (seen.append(self), real(self, *a, **k))[1])
    monkeypatch.setattr(vx, "GROUPS", 6)
    monkeypatch.setattr(vx, "GROUP_UNITS", wide)
    got = vx.decode_states(q, c, "unit", BETAS, block=8, by=["task"]).collect()
    groups = max(3, -(-300 // wide))
    assert [r.count() for r in seen] == [600 * (1 + groups)] and len(got) == 600 * len(BETAS)
    for task in (0, 1):
        y = x * (1 + task * np.arange(6))
        for beta in BETAS:
            want = decoded(scores(y[0], y[1]), beta)
            assert all((r.true_score, r.log_probability, r.fractional_top1) == pytest.approx(want[r.unit], abs=1e-9) for r in got if r.beta == beta and r.task == task)
