"""Toy-row tests of single operators, invariants and degenerate inputs."""

import math

import pytest
from pyspark.sql import functions as F

from statewise.functions import scalars as sc
from statewise.operators import contracts as ct
from statewise.operators import dynamics as dy
from statewise.operators import evidence as ev
from statewise.operators import groups as gr
from statewise.operators import intervals as iv
from statewise.operators import joins as jn
from statewise.operators import metrics as mx
from statewise.operators import models as md
from statewise.operators import resample as rs
from statewise.operators import stats as st
from statewise.operators import vectors as vx
from statewise.sources import scans


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quality_filter_nulls(spark):
    d = spark.createDataFrame([
        (1, True, False, False, False, 2, 250, 1.0, -1.0), (2, True, False, False, False, 1, 250, 1.0, -1.0), (3, None, False, False, False, 2, 250, 1.0, -1.0),
        (4, True, None, False, False, 2, 250, 1.0, -1.0), (5, True, False, False, False, None, 250, 1.0, -1.0), (6, True, False, False, False, 2, 199, 1.0, -1.0)],
        "target int, on_target boolean, low_expression boolean, neighbor_hit boolean, distal_hit boolean, guides int, cells int, base_mean double, effect double")
    assert [r["target"] for r in ct.quality_filter(d).collect()] == [1]
    with pytest.raises(ValueError, match="unique_key"):
        ct.enforce_contract(d.unionByName(d), ["target"], ["target"], [])


def test_alleles(spark):
    d = spark.createDataFrame([("A", "G", "A", "G"), ("A", "G", "G", "A"), ("A", "G", "T", "C"), ("A", "G", "C", "T"), ("A", "G", "A", "C")], "a string, b string, c string, d string")
    got = [r[0] for r in d.select(sc.orient_alleles(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == [1, -1, 1, -1, 0]


def test_validated_join_fails_on_repeats(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    right = spark.createDataFrame([(1, 5), (1, 6)], "k int, y int")
    with pytest.raises(Exception, match="repeated join keys"):
        jn.validated_join(left, right, ["k"], "inner", "m:1").collect()
    assert len(jn.validated_join(left, right.limit(1), ["k"], "inner", "m:1").collect()) == 2


def test_liftover_statuses(spark):
    blocks = spark.createDataFrame([
        ("1", 10, 20, "1", 110, "+", 9.0), ("2", 0, 10, "2", 100, "+", 9.0), ("2", 0, 10, "2", 200, "+", 9.0), ("3", 0, 10, "3", 100, "+", 9.0), ("3", 10, 20, "3", 300, "-", 9.0),
        ("4", 0, 10, "4", 100, "+", 9.0), ("4", 10, 20, "5", 100, "+", 9.0)], "chrom string, block_start long, block_end long, to_chrom string, to_start long, strand string, score double")
    spans = spark.createDataFrame([("m", "1", 10, 20), ("t", "2", 2, 5), ("o", "3", 5, 15), ("c", "4", 5, 15), ("u", "9", 5, 15), ("x", "1", 5, 5)], "id string, chrom string, start_pos long, end_pos long")
    got = {r["id"]: r for r in iv.liftover(spans, blocks, "id").collect()}
    assert (got["m"]["to_start"], got["m"]["to_end"], got["m"]["status"]) == (110, 120, "mapped")
    assert [got[k]["status"] for k in "tocux"] == ["ambiguous_best_endpoint", "endpoint_orientation_mismatch", "endpoint_chromosome_mismatch", "unmapped_endpoint", "invalid_source_interval"]


def test_long_intervals_hit_once(spark):
    spans = spark.createDataFrame([(1, "a", 0, 50_000_000), (2, "a", 999, 1001), (3, "a", 5, 5)], "span_id int, chrom string, start_pos long, end_pos long")
    points = spark.createDataFrame([(i, "a", p) for i, p in enumerate((0, 999, 1000, 1001, 49_999_999, 50_000_000))], "point_id int, chrom string, pos long")
    hits = sorted((r["point_id"], r["span_id"]) for r in iv.points_in_intervals(points, spans, width=16).collect())
    assert hits == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]


def test_fdr_families(spark):
    d = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.04), ("b", 3, 0.03), ("b", 4, None)], "f string, k int, p double")
    got = {r["k"]: r["q"] for r in rs.bh_adjust(d, "p", ["f"]).collect()}
    assert got[1] == pytest.approx(0.02) and got[2] == pytest.approx(0.04) and got[3] == pytest.approx(0.03) and got[4] is None


def test_bootstrap_is_repeatable(spark):
    d = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 3.0), ("B", 4.0)], "t string, v double")
    one = sorted(rows(rs.cluster_bootstrap(d, "t", "v", "median", 40, 1)))
    two = sorted(rows(rs.cluster_bootstrap(d.repartition(7), "t", "v", "median", 40, 1)))
    assert one == two and {v for _, v in one} == {1.5, 2.5, 3.5}


def test_cosine_energy_js(spark):
    e = spark.createDataFrame([("x", "R", "f0", 1.0), ("x", "S", "f0", 1.0), ("y", "S", "f0", 1.0), ("z", "R", "f1", 2.0), ("z", "S", "f1", -1.0)], "target string, state string, feature string, value double")
    cos = {r["target"]: r["cosine"] for r in vx.row_cosine(e, ["target"], ["R", "S"]).collect()}
    assert cos == {"x": 1.0, "y": 0.0, "z": -1.0}
    s = spark.createDataFrame([("a", "R", 0, 3.0), ("a", "R", 1, 4.0), ("a", "S", 0, 3.0), ("a", "S", 1, 4.0), ("b", "R", 0, 0.0), ("b", "R", 1, 0.0)], "target string, state string, module int, score double")
    en = vx.module_energy(s, ["target", "state"])
    assert {(r["module"], round(r["energy"], 9)) for r in en.filter("target = 'a' AND state = 'R'").collect()} == {(0, 0.36), (1, 0.64)}
    assert {r["energy"] for r in en.filter("target = 'b'").collect()} == {0.0}
    assert vx.js_divergence(en.filter("target = 'a'"), ["target"], ["R", "S"]).first()["js"] == pytest.approx(0.0, abs=1e-12)


def test_energy_identity(spark):
    e = spark.createDataFrame([("x", s, f"f{i}", float((i * 7 + len(s) * 3) % 5 - 2) or 1.0) for s in ("A", "BB", "CCC") for i in range(6)], "target string, state string, feature string, value double")
    r = vx.decompose_states(e, ["target"], ["A", "BB", "CCC"]).first()
    assert r["total_energy"] == pytest.approx(r["core_energy"] + r["residual_energy"])


def test_pooling(spark):
    d = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("b", 10.0, 1.0), ("b", 12.0, 1.0)], "g string, v double, w double")
    got = {r["g"]: r["pooled"] for r in gr.partial_pool(d, "g", "v", "w").collect()}
    assert 1.0 < got["a"] < got["b"] < 11.0


def test_operator_powers(spark):
    w = spark.createDataFrame([("a", "b", 0.5)], "source string, target string, weight double")
    got = {(r["source"], r["target"]): r["weight"] for r in dy.horizon_edges(dy.finite_horizon(w, 2, identity=True)).collect()}
    assert got == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 0.5}
    big = spark.createDataFrame([("a", "a", 1.2), ("b", "b", 0.2)], "source string, target string, weight double")
    assert dy.spectral_radius(dy.stabilise(big)).first()[0] == pytest.approx(0.95)
    assert dy.spectral_radius(big, block=1, width=2).first()[0] == pytest.approx(1.2, rel=1e-9)


def test_auroc_single_class_is_null(spark):
    d = spark.createDataFrame([("one", 1, 0.3), ("one", 1, 0.4), ("two", 1, 0.9), ("two", 0, 0.1), ("two", 0, 0.9)], "g string, y int, s double")
    got = {r["g"]: r["auroc"] for r in mx.auroc(d, ["g"], "y", "s").collect()}
    assert got == {"one": None, "two": 0.75}


def test_rewiring_keeps_degrees(spark):
    e = spark.createDataFrame([(i, 100 + (i * k) % 37) for i in range(30) for k in (1, 5, 11)], "a int, b int").distinct()
    moved = rs.rewire_edges(e, "a", "b", 2, 3, 5)
    rep = rs.rewiring_report(moved, e, "a", "b", e).collect()
    assert all(r["edges"] == e.count() and r["wrong_a"] == 0 and r["wrong_b"] == 0 and r["changed"] > 0 for r in rep)
    assert moved.distinct().count() == moved.count()


def test_single_class_training_is_refused(spark):
    d = spark.createDataFrame([(float(i), 1) for i in range(5)], "x double, y int")
    with pytest.raises(ValueError, match="one class"):
        md.balanced_logistic(d, md.preprocess(["x"]), "y")


def test_two_hop_agreement(spark):
    eff = spark.createDataFrame([("s", "R", "m", -2.0), ("s", "R", "d", 1.0)], "source string, state string, response string, effect double")
    prior = spark.createDataFrame([("m", "d", -1)], "source string, response string, prior_direction int")
    r = ev.two_hop_paths(eff, prior).first()
    assert (r["response"], r["agreeing_paths"], r["strongest_intermediate"]) == ("d", 1, "m")


def test_tail_areas(spark):
    from statewise.functions.tails import chi_square_upper, normal_two_sided, student_quantile, student_two_sided

    r = spark.range(1).select(normal_two_sided(F.lit(1.959963984540054)), student_two_sided(F.lit(2.2281388519649385), F.lit(10.0)), chi_square_upper(F.lit(3.841458820694124), F.lit(1.0)),
                              normal_two_sided(F.lit(None).cast("double"))).first()
    assert r[0] == pytest.approx(0.05, abs=1e-12) and r[1] == pytest.approx(0.05, abs=1e-10) and r[2] == pytest.approx(0.05, abs=1e-10) and r[3] is None
    assert student_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    got = spark.range(1, 60).select(F.col("id"), st.log_gamma(F.col("id").cast("double")).alias("g")).collect()
    assert all(r["g"] == pytest.approx(math.lgamma(r["id"]), abs=1e-9) for r in got)


def test_csv_and_bed_scans(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v,w\n1,NA,2.5\n2,x,NaN\n")
    t = scans.scan_table(spark, str(tmp_path / "t.csv"), "k int, v string, w double", "csv", ["k", "v", "w"], ["NA"])
    assert sorted(rows(t)) == [(1, None, 2.5), (2, "x", None)]
    (tmp_path / "b.bed").write_text("# note\nchr1\t5\t9\tname\ntrack x\n2\t0\t4\n")
    assert sorted(rows(scans.scan_intervals(spark, str(tmp_path / "b.bed")))) == [("1", 5, 9), ("2", 0, 4)]
    (tmp_path / "s.gmt").write_text("s1\tnote\ta\tb\tB\ns2\tnote\tq\n")
    u = spark.createDataFrame([("A",), ("B",)], "member string")
    assert sorted(rows(scans.scan_gene_sets(spark, str(tmp_path / "s.gmt"), universe=u, minimum=2))) == [("s1", "A", 2), ("s1", "B", 2)]


def test_stream_borders(spark, tmp_path):
    """Violations and repeats are also found across files, one file per batch."""
    from statewise.streaming import scans as ss

    src = tmp_path / "in"
    batches = [[(0, 1, "a"), (1, 2, "b"), (2, 5, "c")], [(3, 5, "c"), (4, 4, "d")], [(5, 3, "e"), (6, 9, "f")]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, "pos long, coord long, allele string").coalesce(1).write.parquet(str(src / f"p{i}"))
    files = sorted(src.glob("p*/*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    import os
    import shutil
    for i, f in enumerate(files):
        shutil.copy(f, flat / f"{i}.parquet")
        os.utime(flat / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = ss.file_stream(spark, str(flat), spark.read.parquet(str(flat)).schema, files_per_batch=1)
    r = ss.stream_order_check(stream, "pos", "coord", ["coord", "allele"], str(tmp_path / "work")).first()
    assert (r["order_violations"], r["duplicate_keys"], r["rows"]) == (2, 1, 7)


def test_deterministic_over_partitionings(spark):
    d = spark.createDataFrame([(i, i % 3, float(i * i % 17)) for i in range(60)], "k int, s int, v double")
    a = sorted(rows(rs.permuted_values(d, ["s"], ["k"], ["v"], 4, 9)))
    b = sorted(rows(rs.permuted_values(d.repartition(11), ["s"], ["k"], ["v"], 4, 9)))
    assert a == b


def test_nested_elastic_net_equals_fits_on_rows(spark):
    """Every inner and outer model from fold moments against descent on the rows themselves."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)) * [1, 3, 0.2, 5] + 2
    x[rng.random((90, 4)) < 0.1] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 3]), np.nan, 1.0)  # a constant column
    y = np.nan_to_num(x[:, 0]) - 0.5 * np.nan_to_num(x[:, 1]) + rng.normal(size=90) * 0.3
    fold = np.arange(90) % 4
    cell = lambda v: None if np.isnan(v) else float(v)
    df = spark.createDataFrame([(i, int(fold[i]), *map(cell, x[i]), float(y[i])) for i in range(90)], "k int, fold int, a double, b double, c double, d double, y double").repartition(3)
    alphas, ratios = [0.01, 0.3], [0.2, 1.0]
    preds, choices, inner = md.nested_elastic_net(df, "fold", ["a", "b", "c", "d"], "y", alphas, ratios, ["k"], range(4))

    def fit(train, alpha, ratio):
        mean = np.nanmean(x[train], axis=0)
        z = np.where(np.isnan(x), mean, x) - mean
        sd = z[train].std(axis=0)
        z = z / np.where(sd > 1e-12, sd, 1)
        t = z[train]
        b = md.descend(t.T @ t / len(t), t.T @ (y[train] - y[train].mean()) / len(t), alpha, ratio)
        return y[train].mean() + z @ b

    seen = {(r.fold, r.inner_fold, r.alpha, r.l1_ratio): r.mae for r in inner.collect()}
    assert len(seen) == 4 * 3 * 4
    chosen = {r.fold: r for r in choices.collect()}
    got = {r.k: r.prediction for r in preds.collect()}
    for f in range(4):
        mae = {}
        for a in alphas:
            for r in ratios:
                off = []
                for g in range(4):
                    if g != f:
                        e = np.abs(fit((fold != f) & (fold != g), a, r) - y)[fold == g]
                        assert seen[f, g, a, r] == pytest.approx(e.mean(), rel=1e-9)
                        off.extend(e)
                mae[a, r] = np.mean(off)
        a, r = min(mae, key=mae.get)
        assert (chosen[f].alpha, chosen[f].l1_ratio) == (a, r) and chosen[f].optimality < 1e-10
        want = fit(fold != f, a, r)
        assert all(got[i] == pytest.approx(want[i], rel=1e-8) for i in range(90) if fold[i] == f)


def test_files_of_any_size_are_digested(spark, tmp_path, monkeypatch):
    """Streamed, blockwise and whole digests of the same bytes; verification has no size-only state."""
    import hashlib

    monkeypatch.setattr(scans, "STREAM_BYTES", 7)
    data = {"a.bin": b"x" * 100, "b.bin": bytes(range(256)) * 5, "c.bin": b"c", "d e.bin": b"spaces"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    want = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}
    for limit in (0, 50, 1 << 28):
        assert {r["file"]: (r["bytes"], r["sha256"]) for r in scans.file_digests(spark, str(tmp_path), "*.bin", limit).collect()} == want
    got = {r["file"]: r for r in scans.block_digests(spark, str(tmp_path), "*.bin", 64).collect()}
    for n, c in data.items():
        parts = [hashlib.sha256(c[i:i + 64]).hexdigest() for i in range(0, max(len(c), 1), 64)]
        assert (got[n]["bytes"], got[n]["blocks"], got[n]["block_sha256"]) == (len(c), len(parts), hashlib.sha256("".join(parts).encode()).hexdigest())
    manifest = spark.createDataFrame([("a.bin", 100, want["a.bin"][1], None), ("b.bin", 1280, "0" * 64, want["b.bin"][1]), ("c.bin", 1, "0" * 64, None), ("z.bin", 1, "0" * 64, None), ("d e.bin", 5, want["d e.bin"][1], None)],
                                     "file string, bytes long, sha256 string, corrected_sha256 string")
    status = {r["file"]: r["status"] for r in scans.verify_files(scans.file_digests(spark, str(tmp_path), "*.bin", 50), manifest).collect()}
    assert status == {"a.bin": "verified", "b.bin": "verified", "c.bin": "hash_mismatch", "z.bin": "missing", "d e.bin": "size_mismatch"}
