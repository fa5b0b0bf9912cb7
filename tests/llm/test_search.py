"""Exact search against DuckDB and plain Python."""

import math
import random
from collections import Counter

import pytest

from statewise.llm import pivots


def plain(rows, k, modulus, scale):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    answers = {}
    for q, a in good:
        if q % modulus == 0:
            answers.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
    for q, found in answers.items():
        for r, (s, i) in enumerate(sorted(found)[:k], 1):
            out[(q, r, i, -s)] += 1
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_top_k_of_odd_vectors(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(8)]) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 460)]  # ties
    rows += [(1000, None), (1001, [None] * 8), (1050, [float("nan")] * 8), (1100, [float("inf")] * 8), (None, [0.1] * 8), (1150, [0.1, 0.2]), (1151, [0.3, -0.2]), (1200, []), (1201, [])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, score int, id string").repartition(3)
    import numpy as np

    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = pivots.top_k(df, k=k, query_modulus=50)
    assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain(rounded, k, 50, 256)
    assert pivots.top_k(df.limit(0)).count() == 0
