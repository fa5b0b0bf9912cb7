"""Cases that reviews of the larger tables and odd inputs brought up."""

import pytest
from pyspark.sql import functions as F


def test_factor_with_equal_weights_on_all_features_has_no_slope(spark):
    from statewise.operators.vectors import factor_activity

    values = spark.range(7 * 40).select((F.col("id") % 7).alias("row"), F.floor(F.col("id") / 7).alias("feature"), (F.rand(3) / 3 - 0.1).alias("value"))
    net = spark.range(40).select(F.lit("flat").alias("factor"), F.col("id").alias("feature"), F.lit(0.3).alias("weight"))
    net = net.union(spark.range(40).select(F.lit("split"), F.col("id"), F.when(F.col("id") < 11, 1.0).otherwise(-1.0)))
    got = factor_activity(values, net, ["row"], 40).collect()
    assert len(got) == 14
    assert all(r.ulm == 0 for r in got if r.factor == "flat")
    assert all(r.ulm != 0 for r in got if r.factor == "split")


def test_cut_leaves_rows_where_they_are(spark, monkeypatch):
    """A large group must not come into one task to meet its cuts."""
    from statewise.functions import ordering as o

    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), F.hash("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = o._cut(rows, ["g"], "v", 100)
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        sizes = [r["count"] for r in cut.groupBy("g", "__ord_b").count().collect()]
        assert len(sizes) > 1000 and max(sizes) < 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_weighted_quantiles_of_cut_groups(spark):
    """Cuts placed by the base rows give the quantiles of the repeated rows."""
    from statewise.functions import ordering as o

    base = spark.range(400).select(F.col("id").alias("k"), (F.hash("id") % 97).cast("double").alias("v"), (F.col("id") % 3 + 1).alias("w"))
    rows = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r")).filter("(k + r) % 4 <> 0")
    probs = {"a": 0.1, "b": 0.5, "c": 0.975}
    got = {x.r: (x.a, x.b, x.c) for x in o.exact_quantiles(rows, ["r"], "v", probs, limit=20, weight="w", shape=base, again=True).collect()}
    for r in range(5):
        want = []
        values = sorted(x.v for x in rows.filter(F.col("r") == r).collect() for _ in range(x.w))
        for p in probs.values():
            spot = (len(values) - 1) * p
            low, high = values[int(spot)], values[min(int(spot) + 1, len(values) - 1)]
            want.append(low + (high - low) * (spot - int(spot)))
        assert got[r] == pytest.approx(want, abs=1e-12)


def test_drawn_copies_are_the_drawn_rows(spark):
    from statewise.operators import resample as rs

    rows = spark.range(60).select((F.col("id") % 13).alias("c"), F.col("id").alias("v"))
    copies = rs.spread_copies(rs.bootstrap_copies(rows, [], "c", 6, 4)).groupBy("replicate", "c", "v").count()
    drawn = rs.bootstrap_rows(rows, [], "c", 6, 4).select("replicate", "c", "v", "weight")
    assert {tuple(r) for r in copies.collect()} == {tuple(r) for r in drawn.collect()}


@pytest.mark.parametrize("words", [1, 8])
def test_first_hops_without_a_second_end_are_dropped_early(spark, monkeypatch, words):
    """the rows between the hops stay near the paths, and none is lost when the marks are full."""
    from statewise.operators import evidence as ev

    monkeypatch.setattr(ev, "MARK_WORDS", words)
    eff = spark.range(4000).select((F.col("id") % 40).alias("source"), F.element_at(F.array(F.lit("A"), F.lit("N")), (F.col("id") % 2 + 1).cast("int")).alias("state"),
                                   F.pmod(F.hash("id"), F.lit(400)).cast("bigint").alias("response")).distinct().withColumn("effect", F.hash("source", "response") % 9 + 0.5)
    prior = spark.range(6000).select(F.pmod(F.hash("id", F.lit(1)), F.lit(400)).cast("bigint").alias("source"), F.pmod(F.hash("id", F.lit(2)), F.lit(400)).cast("bigint").alias("response")).distinct().withColumn(
        "prior_direction", (F.hash("source", "response") % 2).cast("int"))
    e, p = [tuple(r) for r in eff.collect()], [tuple(r) for r in prior.collect()]
    effect = {(s, t, r): v for s, t, r, v in e}
    steps = {}
    for a, b, d in p:
        if d:
            steps.setdefault(a, []).append(b)
    hops = [(s, t, m, x) for s, t, m, _ in e for x in steps.get(m, ()) if m != s and x != s]
    want = {}
    for s, t, m, x in hops:
        if (s, t, x) in effect:
            want[s, t, x] = want.get((s, t, x), 0) + 1
    assert want and {(r.source, r.state, r.response): r.paths for r in ev.two_hop_paths(eff, prior).collect()} == want
    kept = ev._first_hops(eff, prior).count()
    assert sum(want.values()) <= kept <= len(hops)
    if words == 8:
        assert kept < sum(want.values()) + len(hops) / 10


def test_threshold_grid_reads_only_what_it_counts(spark):
    """effects are counted before they meet the contacts, and no evidence is joined for the grid."""
    import __spark_entry__ as entry

    plan = entry.queries()["e18_threshold_sensitivity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") < plan.index("Aggregate", plan.index("Join"))


@pytest.mark.parametrize("few", [0, 200_000])
def test_rewiring_by_rounds_of_rejected_proposals(spark, monkeypatch, few):
    """the edges are those of the rounds in plain Python, whether the rejected proposals are sent or joined."""
    import hashlib

    from statewise.operators import resample as rs

    monkeypatch.setattr(rs, "FEW_TAKEN", few)
    edges = sorted({(i, (i * k) % 17) for i in range(15) for k in (1, 5, 11) if i != (i * k) % 17})
    want = {}
    for r in range(2):
        now, swaps = list(edges), 0
        for i in range(4):
            if swaps >= len(edges):
                break
            now.sort(key=lambda e: (hashlib.md5(f"5|{i}|{r}|{e[0]}|{e[1]}".encode()).hexdigest(), e))
            pairs = [now[j:j + 2] for j in range(0, len(now), 2)]
            made = [x for p in pairs if len(p) == 2 for x in ((p[0][0], p[1][1]), (p[1][0], p[0][1]))]
            taken = {x for x in made if made.count(x) > 1 or x in now}
            then = []
            for p in pairs:
                new = [(p[0][0], p[1][1]), (p[1][0], p[0][1])] if len(p) == 2 else []
                good = bool(new) and all(x not in taken and x[0] != x[1] for x in new)
                then += new if good else p
                swaps += good
            now = then
        want[r] = (sorted(now), swaps)
    got = rs.rewire_edges(spark.createDataFrame(edges, "a long, b long"), "a", "b", 2, 4, 5).collect()
    for r, (rows, swaps) in want.items():
        assert sorted((x.a, x.b) for x in got if x.replicate == r) == rows
        assert {x.successful_swaps for x in got if x.replicate == r} == {swaps}


def test_rejected_proposals_are_few(spark):
    from statewise.operators import resample as rs

    pairs = spark.createDataFrame([(0, 1, 11, 2, 12, 2), (0, 3, 13, 1, 14, 2), (0, 5, 15, None, None, 1), (0, 3, 12, 6, 15, 2)], "replicate long, a long, b long, c long, d long, k long")
    assert [tuple(r) for r in rs._taken(pairs).collect()] == []
    again = pairs.union(spark.createDataFrame([(0, 7, 18, 1, 18, 2), (0, 2, 19, 9, 11, 2)], pairs.schema))
    assert {tuple(r) for r in rs._taken(again).collect()} == {(0, 2, 11), (0, 1, 18), (0, 7, 18)}


def test_hash_rank_sorts_its_rows_once(spark):
    """the rows are sorted for the window, not again for the join with the shifts."""
    from statewise.functions import ordering as o
    from statewise.functions.hashing import digest

    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", F.lit(5000).alias("n")).withColumn("h", digest(F.col("id")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = o.hash_rank(rows, ["g"], "h", ["id"], "pos", size="n", limit=100)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        above, below = plan.split("SortMergeJoin")
        assert "Sort [" not in above and below.split("Exchange")[0].count("Sort [") == 1
        got = {(r.g, r.pos): r.id for r in ranked.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for g in range(3):
        assert [got[g, i] for i in range(len([k for k in got if k[0] == g]))] == [r.id for r in rows.filter(F.col("g") == g).orderBy("h").collect()]


def test_dose_grid_does_not_go_through_the_shuffle_to_the_pairs(spark):
    """rows meet their pair once, not once for each point of the Hill grid."""
    from statewise.operators import models as md

    rows = [(p, g, (p % 7 + g) / 5, float((p * 3 + g * 5) % 11), p % 3) for p in range(60) for g in (1, 2)]
    df = spark.createDataFrame(rows, "pair_id long, guide long, dose double, y double, fold long")
    out = md.dose_response(df, [], "fold", "pair_id", "guide", "dose", "y", [], ["linear", "hill"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Generate inline", 1)[1].splitlines()
    assert any("Window [" in line and "pair_id" in line for line in below)
    assert out.count() == 240


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """a task's share stays the same on larger tables, whatever the setting."""
    from statewise.functions import ordering as o
    from statewise.sources import scans

    assert o.dealt(spark.range(5000), 5000, "id", limit=100).rdd.getNumPartitions() == 50
    small = spark.range(50)
    assert o.dealt(small, 50, "id", limit=100) is small
    deal, seen = o.dealt, []
    monkeypatch.setattr(scans, "dealt", lambda df, rows, *columns: (seen.append(rows), deal(df, rows, *columns, limit=10))[1])
    lines = spark.createDataFrame([(f"s{i}\tnote\ta\tA\tb{i}\tc{i % 5}\t",) for i in range(100)], "value string")
    universe = spark.createDataFrame([("A",), *[(f"C{i}",) for i in range(4)]], "member string")
    got = {tuple(r) for r in scans.parse_gene_sets(lines, universe, 2, 3).collect()}
    assert got == {(f"s{i}", m, 2) for i in range(100) if i % 5 < 4 for m in ("A", f"C{i % 5}")} and set(seen) == {500}


def test_rounds_of_rewiring_leave_no_tables(spark):
    """the disk holds one round, not all of them, and the pairs without the digests that ordered them."""
    import os

    from statewise.operators import resample as rs
    from statewise.session import cut_lineage, shared_folder

    edges = cut_lineage(spark.range(6000).select((F.col("id") % 300).alias("a"), F.pmod(F.hash("id"), F.lit(2000)).cast("bigint").alias("b")).distinct())
    held = lambda: {os.path.join(d, x): os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(shared_folder(spark).removeprefix("file:")) for x in names}
    before = held()
    out = rs.rewire_edges(edges, "a", "b", 3, 6, 1)
    left = sum(size for name, size in held().items() if name not in before)
    bad = rs.rewiring_invariants(out, edges, "a", "b").collect()
    n = edges.count()
    assert [(r.edges, r.repeated_edges, r.self_edges, r.wrong_a, r.wrong_b) for r in bad] == [(n, 0, 0, 0, 0)] * 3
    assert left < 20 * 3 * n


def test_rank_by_an_expression_shuffles_no_digest(spark):
    """the digest is worked out again on the other side; the next row of a bucket comes with its row."""
    from statewise.functions import ordering as o
    from statewise.functions.hashing import digest

    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", F.lit(5000).alias("n"))
    ranked = o.hash_rank(rows, ["g"], digest(F.col("id")), ["id"], "pos", size="n", limit=100, ahead={"id": "then"}, opens="opens")
    want = {}
    for r in o.hash_rank(rows.withColumn("h", digest(F.col("id"))), ["g"], "h", ["id"], "pos", size="n", limit=100).collect():
        want[r.g, r.pos] = r.id
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "__ord_h" not in plan.split("REPARTITION_BY_COL")[1]
    got = ranked.collect()
    assert {(r.g, r.pos): r.id for r in got} == want
    opens = {(r.g, r.pos) for r in got if r.opens}
    assert all(r.then == (None if (r.g, r.pos + 1) in opens else want.get((r.g, r.pos + 1))) for r in got)
