"""Exact neighbours by pivot cells: same rows as all pairs, with fewer of them compared."""

import numpy as np
import pytest

from statewise.operators import matching as mt


def all_pairs(q, c, k, skip_self=False, within=None):
    out = set()
    for i, g, x in q:
        found = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, h, y in c if h == g and not (skip_self and i == j))
        out |= {(i, s, j) for s, (d, j) in enumerate(found[:k], 1) if within is None or d <= within}
    return out


def table(spark, rows, key):
    return spark.createDataFrame([(i, g, [float(v) for v in x]) for i, g, x in rows], f"{key} long, g string, v array<double>")


@pytest.mark.parametrize(("n", "block", "within"), [(300, 4096, None), (120, 16, None), (300, 4096, 0.4)])
def test_same_rows_as_all_pairs(spark, n, block, within):
    rng = np.random.default_rng(n)
    rows = [(i, "ab"[i % 7 == 0], rng.normal(rng.integers(0, 4), 0.3, 2).round(2)) for i in range(n)]
    rows += [(1000 + i, "a", (0.5, 0.5)) for i in range(60)]  # equal rows, ties
    rows += [(2000, "c", (9.0, 9.0))]  # alone in its group
    df = table(spark, rows, "id").repartition(3)
    got = mt.blocked_knn(df, df, ["g"], "id", "id", "v", 4, block=block, skip_self=True, within=within)
    assert {(r.query, r.slot, r.candidate) for r in got.collect()} == all_pairs(rows, rows, 4, True, within)
    few = table(spark, rows[:3], "id")
    got = mt.blocked_knn(df, few, ["g"], "id", "id", "v", 4)
    assert {(r.query, r.slot, r.candidate) for r in got.collect()} == all_pairs(rows, rows[:3], 4)
    assert mt.blocked_knn(df, df.limit(0), ["g"], "id", "id", "v", 4).count() == 0


def test_compared_pairs_grow_below_the_square(spark):
    counts = []
    for n in (400, 1600, 6400):
        rng = np.random.default_rng(n)
        df = table(spark, [(i, "a", rng.random(2)) for i in range(n)], "id")
        counter = spark.sparkContext.accumulator(0)
        assert mt.blocked_knn(df, df, [], "id", "id", "v", 5, skip_self=True, counter=counter).count() == 5 * n
        counts.append(counter.value)
    assert counts[0] < 0.6 * 400**2 and counts[2] < 0.15 * 6400**2
    assert all(b < 11 * a for a, b in zip(counts, counts[1:]))  # 16 times the pairs each step


def test_rows_are_not_sent_to_cell_after_cell_in_high_dimensions(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, "a", rng.normal(0, 1, 24)) for i in range(900)] + [(1000 + i, "a", np.ones(24)) for i in range(40)]
    df = table(spark, rows, "id").repartition(3)
    sent = []

    def watched(kept):
        kept = cut(kept)
        sent.append(kept.count())
        return kept

    cut = mt.cut_lineage
    monkeypatch.setattr(mt, "cut_lineage", watched)
    got = {(r.query, r.slot, r.candidate) for r in mt.blocked_knn(df, df, [], "id", "id", "v", 4, skip_self=True).collect()}
    assert got == all_pairs(rows, rows, 4, True)
    assert max(sent) <= 4 * len(rows)  # the found rows; visits of all cells would be 30 times the rows
