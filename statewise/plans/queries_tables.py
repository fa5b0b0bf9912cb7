"""Scans, contracts, accounting and column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewise.functions import scalars as sc
from statewise.functions.ordering import dealt
from statewise.operators import contracts as ct
from statewise.plans.bindings import DUCK, q6
from statewise.plans.registry import query, with_views
from statewise.session import scratch_path
from statewise.sources import scans, sinks

D = DUCK


# A. scans and sinks

@query("a1_scan_table", lambda: """
    SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0""")
def _(b):
    t = scans.scan_table(b.spark, b.path("customer"), columns=["c_custkey", "c_mktsegment", "c_acctbal"], na_values=["BUILDING"])
    return t.filter("c_acctbal > 0")


def _loci(b):
    """Nested loci: one order with its lines as variants."""
    line = F.struct(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("variant_id"),
        (F.col("l_quantity") / 64).alias("posterior"),
        (F.col("l_quantity") > 20).alias("in95"), (F.col("l_quantity") > 5).alias("in99"))
    feature = F.struct(F.concat(F.lit("s"), "l_suppkey").alias("feature"), F.col("l_tax").alias("weight"))
    return b.table("lineitem").groupBy(F.col("l_orderkey").alias("locus")).agg(
        F.collect_list(line).alias("rows"), F.collect_set(feature).alias("features"))


@query("a2_scan_nested_summary", lambda: """
    SELECT l_orderkey AS locus, count(*) AS credible_variants,
      arg_min(concat_ws('_', l_orderkey, l_linenumber), (-l_quantity, concat_ws('_', l_orderkey, l_linenumber))) AS lead_variant,
      max(l_quantity / 64) AS lead_posterior FROM lineitem GROUP BY l_orderkey""")
def _(b):
    return scans.locus_summary(_loci(b))


@query("a2_scan_nested_variants", lambda: """
    SELECT l_orderkey AS locus, concat_ws('_', l_orderkey, l_linenumber) AS variant_id, l_quantity / 64 AS posterior,
      l_quantity > 20 AS in95, l_quantity > 5 AS in99 FROM lineitem""")
def _(b):
    return scans.locus_variants(_loci(b))


@query("a2_scan_nested_features", lambda: """
    SELECT DISTINCT l_orderkey AS locus, concat('s', l_suppkey) AS feature, l_tax AS weight FROM lineitem""")
def _(b):
    return scans.locus_features(_loci(b))


@query("a2_threshold_masses", lambda: """
    SELECT l_orderkey AS locus, t AS threshold, count(*) FILTER (WHERE l_quantity > cut) AS variants,
      coalesce(sum(l_quantity / 64) FILTER (WHERE l_quantity > cut), 0) AS mass
    FROM lineitem, (VALUES ('95%', 20), ('99%', 5)) v(t, cut) GROUP BY l_orderkey, t""")
def _(b):
    return scans.threshold_masses(_loci(b), {"95%": "in95", "99%": "in99"})


@query("a3_scan_gene_sets", lambda: """
    WITH m AS (SELECT DISTINCT concat('o', l_orderkey) AS set_id, concat('P', l_partkey) AS member
               FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10),
    s AS (SELECT set_id, count(*) AS set_size FROM m GROUP BY set_id HAVING count(*) BETWEEN 2 AND 4)
    SELECT set_id, member, set_size FROM m JOIN s USING (set_id)""")
def _(b):
    lines = dealt(b.table("lineitem"), b.table("lineitem").count(), "l_orderkey").groupBy("l_orderkey").agg(
        F.concat_ws("\t", F.concat(F.lit("o"), "l_orderkey"), F.lit("note"),
                    F.collect_list(F.concat(F.lit("p"), "l_partkey"))).alias("value"))
    universe = b.table("part").filter("p_size > 10").select(F.concat(F.lit("P"), "p_partkey").alias("member"))
    return scans.parse_gene_sets(lines.select("value"), universe, 2, 4)


@query("a4_scan_intervals", lambda: with_views("spans", """
    SELECT CAST(chrom AS VARCHAR) AS chrom, start_pos, end_pos FROM spans WHERE span_id % 10 <> 0"""))
def _(b):
    lines = b.view("spans").select(F.concat(
        F.when(F.col("span_id") % 10 == 0, "# ").otherwise(""), F.lit("chr"),
        F.concat_ws("\t", "chrom", "start_pos", "end_pos", F.lit("x"))).alias("value"))
    return scans.parse_intervals(lines)


@query("a5_melt_matrix", lambda: """
    SELECT l_orderkey, l_linenumber, feature, value FROM (
      UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
      ON l_quantity, l_discount, l_tax INTO NAME feature VALUE value) WHERE value <> 0""")
def _(b):
    return scans.melt_matrix(b.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("a5_to_long", lambda: with_views("dense", f"""
    SELECT vec_id, CAST(axis AS INT) AS feature, {D.q6('v')} AS value FROM dense WHERE v <> 0"""))
def _(b):
    long = scans.to_long(b.table("embeddings"), ["vec_id"], "embedding")
    return long.select("vec_id", "feature", q6(F.col("value").cast("double")).alias("value"))


def _catalog(b):
    return scans.scan_catalog(
        b.spark,
        [
            {"name": "S1", "path": b.path("supplier"), "attributes": {"kind": "supplier"},
             "rename": {"s_suppkey": "id", "s_acctbal": "value"}},
            {"name": "C1", "path": b.path("customer"), "attributes": {"kind": "customer"},
             "rename": {"c_custkey": "id", "c_acctbal": "value", "c_mktsegment": "segment"}},
            {"name": "P1", "path": b.path("part"), "attributes": {"kind": "part"}, "rename": {"p_partkey": "id"}},
            {"name": "R1", "path": b.path("region"), "attributes": {"kind": "region"}},
        ],
        required=["id", "value"], optional={"segment": "string"})


@query("a6_scan_catalog", lambda: """
    SELECT 'S1' AS file_id, 'supplier' AS kind, s_suppkey AS id, s_acctbal AS value, CAST(NULL AS VARCHAR) AS segment FROM supplier
    UNION ALL SELECT 'C1', 'customer', c_custkey, c_acctbal, c_mktsegment FROM customer""")
def _(b):
    return _catalog(b)[0]


@query("a7_verify_files")
def _(b):
    found = scans.file_digests(b.spark, b.sf_dir, "*.parquet")
    marked = found.withColumn("k", F.hash("file") % 5)
    manifest = marked.filter("k <> 0").select(
        "file", (F.col("bytes") + F.when(F.col("k") == 1, 1).otherwise(0)).alias("bytes"), "sha256",
        F.when(F.col("k") == 2, F.col("sha256")).alias("corrected_sha256"))
    return scans.verify_files(found, manifest)


@query("a8_fingerprint", lambda: """
    SELECT count(*) AS row_count, bit_xor(('0x'||substr(h,1,15))::BIGINT) AS digest_xor,
      CAST(sum(('0x'||substr(h,16,15))::BIGINT % 1000003) AS BIGINT) AS digest_sum
    FROM (SELECT sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), coalesce(nullif(o_orderstatus, 'P'), '\\N'))) AS h
          FROM orders)""")
def _(b):
    orders = scans.null_tokens(b.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["P"])
    return scans.fingerprint(orders, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("a9_write_result", lambda: with_views("summary", """
    SELECT target, state, cells, downstream FROM summary"""))
def _(b):
    rows = b.view("summary").select("target", "state", "cells", "downstream")
    return sinks.write_result(rows, scratch_path(b.spark, "summary"), keys=["target", "state"])


# B. contracts and accounting

@query("b1_check_contract", lambda: """
    SELECT 'required_columns' AS rule, 0::BIGINT AS violations
    UNION ALL SELECT 'unique_key', (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber))
    UNION ALL SELECT 'nonnegative:l_quantity', (SELECT count(*) FROM lineitem WHERE l_quantity < 0)
    UNION ALL SELECT 'nonnegative:l_discount', (SELECT count(*) FROM lineitem WHERE l_discount < 0)""")
def _(b):
    return ct.check_contract(b.table("lineitem"), ["l_orderkey", "l_quantity"], ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


RULES_SQL = {
    "ontarget_significant": "coalesce(on_target, false)",
    "adequate_target_expression": "NOT coalesce(low_expression, true)",
    "no_neighboring_gene_knockdown": "NOT coalesce(neighbor_hit, true)",
    "no_distal_offtarget": "NOT coalesce(distal_hit, true)",
    "minimum_guides": "coalesce(guides >= 2, false)",
    "minimum_cells": "coalesce(cells >= 3, false)",
    "complete_covariates": "(base_mean IS NOT NULL AND effect IS NOT NULL)",
}
ALL_RULES_SQL = " AND ".join(RULES_SQL.values())


@query("b2_quality_filter", lambda: with_views("summary", f"""
    SELECT target, state, cells, guides, {D.q6('effect')} AS effect FROM summary WHERE {ALL_RULES_SQL}"""))
def _(b):
    return ct.quality_filter(b.view("summary"), 2, 3).select("target", "state", "cells", "guides", q6("effect").alias("effect"))


def _audit_sql():
    rules = {"all_rows": "true", **RULES_SQL, "primary_analysis_set": ALL_RULES_SQL}
    parts = [
        f"SELECT '{k}' AS criterion, count(*) FILTER (WHERE {v}) AS rows_passing, "
        f"count(DISTINCT CASE WHEN {v} THEN target END) AS units_passing, "
        f"{D.q6(f'count(*) FILTER (WHERE {v}) * 1.0::DOUBLE / count(*)')} AS fraction_rows FROM summary" for k, v in rules.items()]
    return with_views("summary", " UNION ALL ".join(parts))


@query("b3_audit_counts", _audit_sql)
def _(b):
    return ct.audit_counts(b.view("summary"), ct.quality_rules(2, 3), "target").withColumn("fraction_rows", q6("fraction_rows"))


FLOW = [("low_cells", "cells < 3"), ("not_significant", "NOT coalesce(on_target, false)"), ("neighbor", "coalesce(neighbor_hit, true)"),
        ("no_cluster", "cluster IS NULL")]


def _flow_sql():
    case = "CASE " + " ".join(f"WHEN {p} THEN {i}" for i, (_, p) in enumerate(FLOW)) + f" ELSE {len(FLOW)} END"
    parts = [
        f"SELECT {i} AS stage, '{n}' AS rule, count(*) FILTER (WHERE s = {i}) AS rows_excluded, "
        f"count(DISTINCT CASE WHEN s = {i} THEN target END) AS units_excluded, count(*) FILTER (WHERE s > {i}) AS rows_left, "
        f"count(DISTINCT CASE WHEN s > {i} THEN target END) AS units_left FROM staged" for i, (n, _) in enumerate(FLOW)]
    return with_views("summary", f", staged AS (SELECT target, {case} AS s FROM summary) " + " UNION ALL ".join(parts))


@query("b4_exclusion_flow", _flow_sql)
def _(b):
    return ct.exclusion_flow(b.view("summary"), [(n, F.expr(p)) for n, p in FLOW], "target")


@query("b5_exclusion_ledger", lambda: with_views("summary", f"""
    SELECT target, state, exclusion_reason, exclusion_reason = '' AS passes FROM (SELECT target, state, concat_ws(';',
      {', '.join(f"CASE WHEN coalesce({p}, true) THEN '{n}' END" for n, p in FLOW)}) AS exclusion_reason FROM summary)"""))
def _(b):
    rows = b.view("summary")
    return ct.exclusion_ledger(rows, [(n, F.expr(p)) for n, p in FLOW]).select("target", "state", "exclusion_reason", "passes")


@query("b6_availability_gate", lambda: with_views("summary", """
    SELECT target, rows_seen, cells,
      CASE WHEN best_effect IS NULL THEN 'unavailable' WHEN cells < 25 OR rows_seen < 3 THEN 'underpowered' ELSE 'available' END AS status,
      CASE WHEN best_effect IS NULL THEN 'effect' WHEN cells < 25 THEN 'cells' WHEN rows_seen < 3 THEN 'states' ELSE '' END AS reason,
      CASE WHEN best_effect IS NULL THEN NULL WHEN cells < 25 THEN cells::DOUBLE WHEN rows_seen < 3 THEN rows_seen::DOUBLE END AS gate_value,
      CASE WHEN best_effect IS NULL THEN 0.0::DOUBLE WHEN cells < 25 THEN 25.0::DOUBLE WHEN rows_seen < 3 THEN 3.0::DOUBLE END AS gate_needed
    FROM (SELECT target, count(*) AS rows_seen, sum(cells)::BIGINT AS cells, max(CASE WHEN on_target THEN 1.0 END) AS best_effect
          FROM summary GROUP BY target)"""))
def _(b):
    per = b.view("summary").groupBy("target").agg(
        F.count(F.lit(1)).alias("rows_seen"), F.sum("cells").alias("cells"), F.max(F.when(F.col("on_target"), 1.0)).alias("best_effect"))
    gates = [("effect", F.col("best_effect"), 0), ("cells", F.col("cells"), 25), ("states", F.col("rows_seen"), 3)]
    return ct.availability_gate(per, gates).drop("best_effect")


@query("b7_decide", lambda: with_views("summary", """
    SELECT target, CASE WHEN NOT n >= 3 THEN 'underpowered' WHEN lo IS NULL OR hi IS NULL OR q IS NULL THEN 'unresolved'
      WHEN lo > 0 AND q < 0.5 THEN 'supported' WHEN hi < 0 THEN 'failed' ELSE 'mixed' END AS decision
    FROM (SELECT target, count(*) AS n, min(effect) AS lo, max(effect) AS hi, max(CASE WHEN guides IS NULL THEN NULL ELSE 1.0 / guides END) AS q
          FROM summary GROUP BY target)"""))
def _(b):
    per = b.view("summary").groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.min("effect").alias("lo"), F.max("effect").alias("hi"), F.max(1.0 / F.col("guides")).alias("q"))
    return per.select("target", ct.decide(F.col("lo"), F.col("hi"), F.col("q"), F.col("n") >= 3, 0.5).alias("decision"))


@query("b8_priority_class", lambda: with_views("summary", """
    SELECT target, state, CASE WHEN on_target AND guides >= 5 THEN 'tier_1' WHEN on_target THEN 'tier_2'
      WHEN cells >= 10 THEN 'tier_3' ELSE 'tier_4' END AS tier FROM summary"""))
def _(b):
    rules = [(F.col("on_target") & (F.col("guides") >= 5), "tier_1"), (F.col("on_target"), "tier_2"), (F.col("cells") >= 10, "tier_3")]
    return b.view("summary").select("target", "state", ct.priority_class(rules, "tier_4").alias("tier"))


def _gwas_frame(b):
    return b.view("gwas").withColumn("chromosome", F.concat(F.lit("chr"), "chrom_no")).drop("chrom_no")


GWAS_SQL = """, f AS (SELECT *, CAST(chrom_no AS VARCHAR) AS chrom, effect_allele AS a1, other_allele AS a2, least(eaf, 1 - eaf) AS maf,
    (chrom_no BETWEEN 1 AND 22 AND pos > 0) AS coordinate_ok, (other_allele <> 'N' AND effect_allele <> other_allele) AS allele_ok,
    coalesce(odds_ratio > 0, false) AS effect_ok, standard_error > 0 AS se_ok, (p_value > 0 AND p_value <= 1) AS p_ok,
    coalesce(eaf > 0 AND eaf < 1, false) AS frequency_ok, (info >= 0 AND info <= 1) AS info_ok,
    coalesce((effect_allele || other_allele) IN ('AT','TA','CG','GC') AND least(eaf, 1 - eaf) > 0.42, false) AS ambiguous FROM gwas),
  g AS (SELECT *, coordinate_ok AND allele_ok AND effect_ok AND se_ok AND p_ok AND frequency_ok AND info_ok AND NOT ambiguous AS common FROM f) """


@query("b9_gwas_quality_scan", lambda: with_views("gwas", GWAS_SQL + """,
  c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE NOT coordinate_ok) AS canonical_coordinate_fail,
    count(*) FILTER (WHERE NOT allele_ok) AS allele_fail, count(*) FILTER (WHERE NOT effect_ok) AS effect_fail,
    count(*) FILTER (WHERE NOT se_ok) AS standard_error_fail, count(*) FILTER (WHERE NOT p_ok) AS p_value_fail,
    0::BIGINT AS sample_size_fail, count(*) FILTER (WHERE NOT frequency_ok) AS frequency_fail, count(*) FILTER (WHERE NOT info_ok) AS info_range_fail,
    count(*) FILTER (WHERE info_ok AND info < 0.80) AS info_below_0_8, count(*) FILTER (WHERE ambiguous) AS palindrome_high_maf,
    count(*) FILTER (WHERE common AND info >= 0.8) AS harmonized_rows, count(*) FILTER (WHERE common AND info >= 0.9 AND maf >= 0.01) AS strict_quality_rows,
    count(*) FILTER (WHERE common AND info >= 0.8 AND p_value < 5e-8) AS significant_rows FROM g),
  k AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_keys FROM (SELECT count(*) AS n FROM g WHERE coordinate_ok AND allele_ok GROUP BY chrom, pos, a1, a2)),
  m AS (SELECT coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i), '') AS missing_chromosomes FROM range(1, 23) r(i)
        WHERE i NOT IN (SELECT chrom_no FROM g WHERE coordinate_ok))
  SELECT c.*, k.*, m.*, concat_ws(';', CASE WHEN missing_chromosomes <> '' THEN 'missing_chromosome:' || missing_chromosomes END,
    CASE WHEN duplicate_keys::DOUBLE / rows > 0.001 THEN 'duplicate_fraction_exceeded' END,
    CASE WHEN effect_fail::DOUBLE / rows > 0.05 THEN 'unresolved_direction_fraction_exceeded' END,
    'dense_coverage_reference_unavailable') AS stop_reasons FROM c, k, m"""))
def _(b):
    return ct.gwas_quality_scan(_gwas_frame(b))


@query("b9_gwas_harmonized", lambda: with_views("gwas", GWAS_SQL + f"""
  SELECT rsid AS "SNP", chrom AS "CHR", pos AS "BP", a1 AS "A1", a2 AS "A2", {D.q6('ln(odds_ratio)')} AS "BETA", {D.q6('standard_error')} AS "SE",
    {D.q6('p_value')} AS "P", n AS "N", {D.q6('eaf')} AS "EAF", {D.q6('maf')} AS "MAF", {D.q6('info')} AS "INFO", (info >= 0.9 AND maf >= 0.01) AS "LDSC_QUALITY"
  FROM g WHERE common AND info >= 0.8"""))
def _(b):
    out = ct.gwas_harmonized(_gwas_frame(b))
    return out.withColumns({c: q6(c) for c in ("BETA", "SE", "P", "EAF", "MAF", "INFO")})


@query("b10_order_and_duplicate_check", lambda: """
    SELECT count(*) FILTER (WHERE user_id < prev) AS order_violations, (SELECT sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type)) AS duplicate_keys,
      (SELECT count(*) FROM events) AS rows FROM (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS prev FROM events)""")
def _(b):
    return ct.order_and_duplicate_check(b.table("events"), "event_id", "user_id", ["user_id", "event_type"])


@query("b11_assert_unique_mapping", lambda: """
    SELECT l_orderkey, count(DISTINCT l_returnflag) AS "values" FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1""")
def _(b):
    return ct.assert_unique_mapping(b.table("lineitem"), ["l_orderkey"], "l_returnflag")


# C. column functions

@query("c1_transfer_features", lambda: with_views("summary", f"""
    SELECT target, state, {D.q6('abs(effect)')} AS cis_magnitude, {D.q6('ln(1 + base_mean)')} AS log1p_base_mean, {D.q6('ln(1 + cells)')} AS log1p_cells,
      {D.q6('ln(1 + downstream)')} AS log1p_downstream, {D.q6('downstream::DOUBLE / cells')} AS response_per_cell,
      {D.q6('least(greatest(downstream::DOUBLE / cells, 0.25), 0.75)')} AS clipped FROM summary"""))
def _(b):
    f = sc.transfer_features(b.view("summary"))
    f = f.withColumn("clipped", sc.clip(F.col("response_per_cell"), 0.25, 0.75))
    return f.select("target", "state", *[q6(c).alias(c) for c in (
        "cis_magnitude", "log1p_base_mean", "log1p_cells", "log1p_downstream", "response_per_cell", "clipped")])


@query("c2_hash_fold", lambda: f"""
    SELECT p_partkey, 1 + {D.fold('p_partkey', 10)} AS fold_plain, {D.fold("concat(p_partkey, '|20260912')", 10)} AS fold_seeded,
      {D.fold("concat(p_partkey, '|cascade')", 5)} AS fold_suffix, {D.fold('p_partkey', 5, 12)} AS fold_short,
      ('0x' || substr(h,15,2) || substr(h,13,2) || substr(h,11,2) || substr(h,9,2) || substr(h,7,2) || substr(h,5,2) || substr(h,3,2) || substr(h,1,2))::UBIGINT::HUGEINT::DECIMAL(38,0) % 5 AS d
    FROM (SELECT *, sha256(concat('20260912|', p_partkey)) AS h FROM part)""".replace(" AS d\n", "::BIGINT AS fold_little_endian\n").replace("::UBIGINT::HUGEINT::DECIMAL(38,0) % 5::BIGINT", "::UBIGINT % 5)::BIGINT").replace("('0x' || substr(h,15", "(('0x' || substr(h,15"))
def _(b):
    k = F.col("p_partkey")
    return b.table("part").select(
        "p_partkey", sc.hash_fold(k, 10).alias("fold_plain"),
        sc.hash_fold(F.concat(k, F.lit("|20260912")), 10, base=0).alias("fold_seeded"),
        sc.hash_fold(F.concat(k, F.lit("|cascade")), 5, base=0).alias("fold_suffix"),
        sc.hash_fold(k, 5, base=0, digits=12).alias("fold_short"),
        sc.little_endian_fold(F.concat(F.lit("20260912|"), k), 5).alias("fold_little_endian"))


ORIENT_SQL = """CASE WHEN c.assessed = t.assessed AND c.other = t.other THEN 1 WHEN c.assessed = t.other AND c.other = t.assessed THEN -1
      WHEN c.assessed = translate(t.assessed, 'ACGT', 'TGCA') AND c.other = translate(t.other, 'ACGT', 'TGCA') THEN 1
      WHEN c.assessed = translate(t.other, 'ACGT', 'TGCA') AND c.other = translate(t.assessed, 'ACGT', 'TGCA') THEN -1 ELSE 0 END"""


@query("c3_orient_alleles", lambda: with_views("cis trans", f"""
    SELECT orientation, count(*) AS n FROM (SELECT {ORIENT_SQL} AS orientation FROM cis c JOIN trans t ON c.snp = t.snp) GROUP BY orientation"""))
def _(b):
    c, t = b.view("cis").alias("c"), b.view("trans").alias("t")
    o = sc.orient_alleles(F.col("c.assessed"), F.col("c.other"), F.col("t.assessed"), F.col("t.other"))
    return c.join(t, F.col("c.snp") == F.col("t.snp")).groupBy(o.alias("orientation")).agg(F.count(F.lit(1)).alias("n"))


@query("c4_is_palindromic", lambda: with_views("gwas", """
    SELECT effect_allele, other_allele, (effect_allele || other_allele) IN ('AT','TA','CG','GC') AS palindromic, count(*) AS n FROM gwas GROUP BY ALL"""))
def _(b):
    p = sc.is_palindromic(F.col("effect_allele"), F.col("other_allele"))
    return b.view("gwas").groupBy("effect_allele", "other_allele", p.alias("palindromic")).agg(F.count(F.lit(1)).alias("n"))


@query("c5_predicted_direction", lambda: with_views("cis effects", f"""
    SELECT e.target, e.state, e.feature, CAST(sign(-sign(c.z) * e.value) AS INT) AS direction, count(*) AS n,
      {D.q6('sum(-sign(c.z) * e.value)')} AS predicted
    FROM cis c JOIN effects e ON c.gene = e.target WHERE c.fdr <= 0.4 GROUP BY ALL"""))
def _(b):
    c, e = b.view("cis"), b.view("effects")
    p = sc.predicted_direction(F.col("value"), F.col("z"))
    j = c.filter("fdr <= 0.4").join(e, c["gene"] == e["target"]).select("target", "state", "feature", p.alias("p"))
    return j.groupBy("target", "state", "feature", F.signum("p").cast("int").alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), q6(F.sum("p")).alias("predicted"))


@query("c6_canonical_key", lambda: with_views("gwas", """
    SELECT DISTINCT concat_ws(':', chrom_no, pos, effect_allele, other_allele) AS variant_key, concat(chrom_no, ':', pos, '-', pos + 1) AS element_key,
      concat_ws('|', least(effect_allele, other_allele), greatest(effect_allele, other_allele), 'acc') AS pair_key FROM gwas"""))
def _(b):
    c = F.col
    return b.view("gwas").select(
        sc.variant_key(c("chrom_no"), c("pos"), c("effect_allele"), c("other_allele")).alias("variant_key"),
        sc.element_key(c("chrom_no"), c("pos"), c("pos") + 1).alias("element_key"),
        sc.pair_key(c("effect_allele"), c("other_allele"), F.lit("acc")).alias("pair_key")).distinct()


@query("c7_parse_members", lambda: """
    SELECT DISTINCT l_orderkey AS cluster, concat('g', l_partkey) AS member, l_returnflag AS state FROM lineitem WHERE l_returnflag <> 'R'""")
def _(b):
    cells = b.table("lineitem").groupBy(F.col("l_orderkey").alias("cluster")).agg(F.concat(
        F.lit("["), F.concat_ws(", ", F.collect_list(F.concat(F.lit("'g"), "l_partkey", F.lit("_"), "l_returnflag", F.lit("'")))), F.lit("]")).alias("members"))
    return sc.parse_members(cells, "members", ["cluster"], ["A", "N"])


@query("c8_parse_cells", lambda: f"""
    SELECT event_id, event_type = 'click' AS flag, regexp_extract(props, '"k": (\\d+)', 1) AS k,
      {D.q6("length(regexp_replace(upper(props || event_type), '[^GC]', '', 'g'))::DOUBLE / length(props || event_type)")} AS gc,
      upper(event_type) AS symbol FROM events""")
def _(b):
    kind = F.when(F.col("event_type") == "click", "TRUE").otherwise("no")
    return b.table("events").select(
        "event_id", sc.parse_bool(kind).alias("flag"), F.regexp_extract("props", r'"k": (\d+)', 1).alias("k"),
        q6(sc.gc_fraction(F.concat("props", "event_type"))).alias("gc"),
        sc.strip_alias(F.concat_ws("-", "event_type", (F.col("event_id") % 3).cast("string"))).alias("symbol"))


@query("c9_minmax_scale", lambda: with_views("summary", f"""
    SELECT target, state, {D.q6('(cells - min(cells) OVER (PARTITION BY state))::DOUBLE / (max(cells) OVER (PARTITION BY state) - min(cells) OVER (PARTITION BY state))')} AS cells_scaled,
      {D.q6('(effect - min(effect) OVER (PARTITION BY state)) / (max(effect) OVER (PARTITION BY state) - min(effect) OVER (PARTITION BY state))')} AS effect_scaled FROM summary"""))
def _(b):
    s = sc.minmax_scale(b.view("summary").select("target", "state", "cells", "effect"), ["cells", "effect"], ["state"])
    return s.select("target", "state", q6("cells_scaled").alias("cells_scaled"), q6("effect_scaled").alias("effect_scaled"))


@query("c10_missing_indicators", lambda: with_views("summary", f"""
    SELECT target, state, {D.q6('coalesce(base_mean, (SELECT quantile_cont(base_mean, 0.5) FROM summary))')} AS base_mean,
      {D.q6('coalesce(guides, (SELECT quantile_cont(guides::DOUBLE, 0.5) FROM summary))')} AS guides,
      CAST(base_mean IS NULL AS INT) AS base_mean_missing, CAST(guides IS NULL AS INT) AS guides_missing FROM summary"""))
def _(b):
    s = b.view("summary").select("target", "state", "base_mean", "guides")
    m = sc.missing_indicators(s, ["base_mean", "guides"])
    return m.withColumns({"base_mean": q6("base_mean"), "guides": q6("guides")})
