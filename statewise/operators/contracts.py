"""Contracts, quality filters, exclusion accounting and decision labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.ordering import attach_scalar
from statewise.functions.scalars import is_palindromic


def check_contract(
    df: DataFrame, required: Sequence[str], unique_key: Sequence[str] = (), nonneg: Sequence[str] = ()
) -> DataFrame:
    """One row per rule with its number of violations."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    out = spark.range(1).select(
        F.lit("required_columns").alias("rule"), F.lit(len(missing)).cast("bigint").alias("violations")
    )
    if missing:
        return out
    if unique_key:
        repeated = df.groupBy(*unique_key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        out = out.unionByName(repeated.agg(
            F.lit("unique_key").alias("rule"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("violations")))
    if nonneg:
        sums = df.agg(*[F.coalesce(F.sum((F.col(c) < 0).cast("bigint")), F.lit(0)).alias(c) for c in nonneg])
        sums = sums.unpivot([], list(nonneg), "c", "violations")
        out = out.unionByName(sums.select(F.concat(F.lit("nonnegative:"), "c").alias("rule"), "violations"))
    return out


def enforce_contract(df: DataFrame, required: Sequence[str], unique_key: Sequence[str] = (), nonneg: Sequence[str] = ()) -> None:
    """Raise when any rule is violated (one small result reaches the driver)."""
    broken = check_contract(df, required, unique_key, nonneg).filter("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))


def quality_rules(min_guides: int = 2, min_cells: int = 200) -> dict[str, Column]:
    """Null-aware rules: missing significance fails, a missing exclusion flag excludes."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    clear = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    atleast = lambda c, m: F.coalesce(F.col(c) >= m, F.lit(False))
    return {
        "ontarget_significant": yes("on_target"),
        "adequate_target_expression": clear("low_expression"),
        "no_neighboring_gene_knockdown": clear("neighbor_hit"),
        "no_distal_offtarget": clear("distal_hit"),
        "minimum_guides": atleast("guides", min_guides),
        "minimum_cells": atleast("cells", min_cells),
        "complete_covariates": F.col("base_mean").isNotNull() & F.col("effect").isNotNull(),
    }


def quality_filter(df: DataFrame, min_guides: int = 2, min_cells: int = 200) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, quality_rules(min_guides, min_cells).values()))


def audit_counts(df: DataFrame, rules: Mapping[str, Column], unit: str) -> DataFrame:
    """Marginal rows, distinct units and row share per rule, in one pass.

    Units are counted by a two-level sum instead of one distinct per rule.
    """
    masks = {"all_rows": F.lit(True), **rules, "primary_analysis_set": reduce(lambda a, b: a & b, rules.values())}
    names = list(masks)
    per_unit = df.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(masks[m].cast("bigint")).alias(f"r{i}") for i, m in enumerate(names)],
    )
    total = per_unit.agg(
        F.sum("n").alias("n"),
        *[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(names))],
        *[F.sum((F.col(f"r{i}") > 0).cast("bigint")).alias(f"u{i}") for i in range(len(names))],
    )
    rows = F.array(*[
        F.struct(F.lit(m).alias("criterion"), F.col(f"r{i}").alias("rows_passing"), F.col(f"u{i}").alias("units_passing"),
                 (F.col(f"r{i}") / F.col("n")).alias("fraction_rows"))
        for i, m in enumerate(names)
    ])
    return total.select(F.explode(rows).alias("x")).select("x.*")


def exclusion_flow(df: DataFrame, rules: Sequence[tuple[str, Column]], unit: str) -> DataFrame:
    """Staged funnel: rows and units removed at and left after each stage.

    ``rules`` are exclusion predicates in order; a row leaves at the first hit.
    """
    stage = F.lit(len(rules))
    for i, (_, bad) in reversed(list(enumerate(rules))):
        stage = F.when(F.coalesce(bad, F.lit(False)), F.lit(i)).otherwise(stage)
    cells = df.groupBy(unit, stage.alias("s")).agg(F.count(F.lit(1)).alias("c"))
    per_unit = cells.groupBy(unit).agg(
        F.max("s").alias("last"),
        *[F.coalesce(F.sum(F.when(F.col("s") == i, F.col("c"))), F.lit(0)).alias(f"x{i}") for i in range(len(rules) + 1)],
    )
    total = per_unit.agg(
        *[F.sum(f"x{i}").alias(f"x{i}") for i in range(len(rules) + 1)],
        *[F.sum((F.col(f"x{i}") > 0).cast("bigint")).alias(f"u{i}") for i in range(len(rules))],
        *[F.sum((F.col("last") > i).cast("bigint")).alias(f"k{i}") for i in range(len(rules))],
    )
    rows = []
    for i, (name, _) in enumerate(rules):
        left = reduce(lambda a, b: a + b, [F.col(f"x{j}") for j in range(i + 1, len(rules) + 1)])
        rows.append(F.struct(
            F.lit(i).alias("stage"), F.lit(name).alias("rule"), F.col(f"x{i}").alias("rows_excluded"),
            F.col(f"u{i}").alias("units_excluded"), left.alias("rows_left"), F.col(f"k{i}").alias("units_left")))
    return total.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def exclusion_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """All failed rules of a unit joined by ';' (empty when it passes)."""
    return F.concat_ws(";", *[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules])


def exclusion_ledger(df: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "exclusion_reason") -> DataFrame:
    return df.withColumn(out, exclusion_reason(rules)).withColumn("passes", F.col(out) == "")


def availability_gate(df: DataFrame, gates: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """Gates (name, measured, needed): first failing gate gives the reason;
    a NULL measure is unavailable, a short one underpowered."""
    status, reason = F.lit("available"), F.lit("")
    numerator, denominator = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, measured, needed in reversed(gates):
        short = measured.isNull() | (measured < needed)
        label = F.when(measured.isNull(), "unavailable").otherwise("underpowered")
        status = F.when(short, label).otherwise(status)
        reason = F.when(short, F.lit(name)).otherwise(reason)
        numerator = F.when(short, measured.cast("double")).otherwise(numerator)
        denominator = F.when(short, F.lit(float(needed))).otherwise(denominator)
    return df.select("*", status.alias("status"), reason.alias("reason"),
                     numerator.alias("gate_value"), denominator.alias("gate_needed"))


def decide(low: Column, high: Column, q: Column, powered: Column | None = None, level: float = 0.05) -> Column:
    """supported / failed / mixed from the interval sign and q; NULL input is unresolved."""
    out = (
        F.when(low.isNull() | high.isNull() | q.isNull(), "unresolved")
        .when((low > 0) & (q < level), "supported")
        .when(high < 0, "failed")
        .otherwise("mixed")
    )
    return out if powered is None else F.when(~powered, "underpowered").otherwise(out)


def priority_class(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """First matching label."""
    out = F.lit(default)
    for hit, label in reversed(rules):
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def assert_unique_mapping(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys that map to more than one value (empty when the mapping is sound)."""
    per = df.groupBy(*key, value).agg(F.lit(1).alias("one")).filter(F.col(value).isNotNull())
    return per.groupBy(*key).agg(F.sum("one").alias("values")).filter("values > 1")


AUTOSOMES = 22


def gwas_flags(df: DataFrame) -> DataFrame:
    """Normalised association rows with one validity flag per rule.

    Inputs: chromosome, pos, effect_allele, other_allele, odds_ratio or beta,
    standard_error, eaf or maf, p_value, info, n.
    """
    chrom = F.regexp_replace(F.col("chromosome").cast("string"), "^chr", "")
    a1, a2 = F.upper("effect_allele"), F.upper("other_allele")
    autosome = chrom.isin(*[str(i) for i in range(1, AUTOSOMES + 1)])
    real = lambda ok: F.coalesce(ok, F.lit(False))
    if "odds_ratio" in df.columns:
        effect_ok = real(F.col("odds_ratio") > 0)
        beta = F.when(effect_ok, F.log("odds_ratio"))
    else:
        effect_ok, beta = F.col("beta").isNotNull(), F.col("beta")
    if "eaf" in df.columns:
        eaf = F.col("eaf")
        frequency_ok, maf = real((eaf > 0) & (eaf < 1)), F.least(eaf, 1 - eaf)
    else:
        maf, eaf = F.col("maf"), F.lit(None).cast("double")
        frequency_ok = real((maf > 0) & (maf <= 0.5))
    info = F.col("info")
    bases = ["A", "C", "G", "T"]
    base = df.withColumns({
        "chrom": chrom, "a1": a1, "a2": a2, "beta_out": beta, "eaf_out": eaf, "maf_out": maf,
        "coordinate_ok": real(autosome & (F.col("pos") > 0)),
        "allele_ok": real(a1.isin(bases) & a2.isin(bases) & (a1 != a2)),
        "effect_ok": effect_ok,
        "se_ok": real(F.col("standard_error") > 0),
        "p_ok": real((F.col("p_value") > 0) & (F.col("p_value") <= 1)),
        "n_ok": real(F.col("n") > 0),
        "frequency_ok": frequency_ok,
        "info_ok": real((info >= 0) & (info <= 1)),
        "ambiguous": real(is_palindromic(a1, a2) & (maf > 0.42)),
    })
    common = reduce(lambda a, b: a & b, [F.col(c) for c in (
        "coordinate_ok", "allele_ok", "effect_ok", "se_ok", "p_ok", "n_ok", "frequency_ok", "info_ok")]) & ~F.col("ambiguous")
    return base.withColumns({
        "harmonized": common & real(info >= 0.80),
        "strict_quality": common & real(info >= 0.90) & real(F.col("maf_out") >= 0.01),
    })


def gwas_counts() -> list[Column]:
    """Counters over flagged rows; sums only, so they also run on a stream."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    bad = {
        "canonical_coordinate_fail": "coordinate_ok", "allele_fail": "allele_ok", "effect_fail": "effect_ok",
        "standard_error_fail": "se_ok", "p_value_fail": "p_ok", "sample_size_fail": "n_ok",
        "frequency_fail": "frequency_ok", "info_range_fail": "info_ok",
    }
    return [
        F.count(F.lit(1)).alias("rows"),
        *[n(~F.col(flag)).alias(name) for name, flag in bad.items()],
        n(F.col("info_ok") & (F.col("info") < 0.80)).alias("info_below_0_8"),
        n(F.col("ambiguous")).alias("palindrome_high_maf"),
        n(F.col("harmonized")).alias("harmonized_rows"),
        n(F.col("strict_quality")).alias("strict_quality_rows"),
        n(F.col("harmonized") & (F.col("p_value") < 5e-8)).alias("significant_rows"),
    ]


def gwas_quality_scan(df: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """One row of counters, missing chromosomes, duplicate keys and stop reasons."""
    flagged = gwas_flags(df)
    chromosomes = [F.sum((F.col("coordinate_ok") & (F.col("chrom") == str(i))).cast("bigint")).alias(f"c{i}")
                   for i in range(1, AUTOSOMES + 1)]
    counts = flagged.agg(*gwas_counts(), *chromosomes)
    keyed = flagged.filter("coordinate_ok AND allele_ok").groupBy("chrom", "pos", "a1", "a2").agg(F.count(F.lit(1)).alias("c"))
    doubles = keyed.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_keys"))
    out = attach_scalar(counts, doubles)
    missing = F.concat_ws(",", *[F.when(F.coalesce(F.col(f"c{i}"), F.lit(0)) == 0, F.lit(str(i))) for i in range(1, AUTOSOMES + 1)])
    out = out.withColumn("missing_chromosomes", missing)
    share = lambda c: F.when(F.col("rows") > 0, F.col(c) / F.col("rows")).otherwise(F.lit(1.0))
    coverage = F.lit(None) if expected_rows is None else F.col("rows") / float(expected_rows)
    reasons = F.concat_ws(
        ";",
        F.when(missing != "", F.concat(F.lit("missing_chromosome:"), missing)),
        F.when(share("duplicate_keys") > 0.001, "duplicate_fraction_exceeded"),
        F.when(share("effect_fail") > 0.05, "unresolved_direction_fraction_exceeded"),
        F.when(coverage.isNull(), "dense_coverage_reference_unavailable").when(coverage < 0.90, "dense_coverage_failed"),
    )
    return out.withColumn("stop_reasons", reasons).drop(*[f"c{i}" for i in range(1, AUTOSOMES + 1)])


def gwas_harmonized(df: DataFrame, significant: bool = False) -> DataFrame:
    """The harmonised rows (or the significant ones) in the published layout."""
    rows = gwas_flags(df).filter("harmonized")
    if significant:
        rows = rows.filter("p_value < 5e-8")
    canonical = F.concat_ws(":", "chrom", "pos", "a1", "a2")
    snp = F.coalesce("rsid", canonical) if "rsid" in df.columns else canonical
    return rows.select(
        snp.alias("SNP"), F.col("chrom").alias("CHR"), F.col("pos").alias("BP"), F.col("a1").alias("A1"),
        F.col("a2").alias("A2"), F.col("beta_out").alias("BETA"), F.col("standard_error").alias("SE"),
        F.col("p_value").alias("P"), F.col("n").alias("N"), F.col("eaf_out").alias("EAF"), F.col("maf_out").alias("MAF"),
        F.col("info").alias("INFO"), F.col("strict_quality").alias("LDSC_QUALITY"))


def order_violations(df: DataFrame, position: str, coordinate: str, block: int = 1 << 20) -> DataFrame:
    """Rows whose coordinate is below that of the row before them.

    Rows are compared inside blocks of the position; the seams between blocks
    are compared on one first/last row per block.
    """
    rows = df.select(F.floor(F.col(position) / block).alias("b"), F.col(position).alias("p"), F.col(coordinate).alias("c"))
    prev = F.lag("c").over(Window.partitionBy("b").orderBy("p"))
    inside = rows.select("b", (F.col("c") < prev).alias("bad")).agg(F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("n"))
    ends = rows.groupBy("b").agg(F.min_by("c", "p").alias("first_c"), F.max_by("c", "p").alias("last_c"))
    seams = ends.select((F.col("first_c") < F.lag("last_c").over(Window.orderBy("b"))).alias("bad"))
    seams = seams.agg(F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("n"))
    return inside.unionByName(seams).agg(F.sum("n").alias("order_violations"))


def order_and_duplicate_check(df: DataFrame, position: str, coordinate: str, key: Sequence[str]) -> DataFrame:
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_keys"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows"))
    return attach_scalar(order_violations(df, position, coordinate), repeated)
