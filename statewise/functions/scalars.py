"""Column-level functions: features, folds, alleles, keys, text cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewise.functions.ordering import attach, attach_scalar, exact_quantiles


def transfer_features(df: DataFrame, effect: str = "effect", base: str = "base_mean", cells: str = "cells",
                      downstream: str = "downstream") -> DataFrame:
    return df.withColumns({
        "cis_magnitude": F.abs(effect),
        "log1p_base_mean": F.log1p(F.col(base)),
        "log1p_cells": F.log1p(F.col(cells).cast("double")),
        "log1p_downstream": F.log1p(F.col(downstream).cast("double")),
        "response_per_cell": F.try_divide(F.col(downstream).cast("double"), F.col(cells).cast("double")),
    })


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def hash_fold(key: Column, folds: int = 10, base: int = 1, digits: int = 16) -> Column:
    """Fold from the leading hex digits of SHA-256; vary the key text for seeds."""
    number = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, digits), 16, 10).cast("decimal(20,0)")
    return (F.lit(base) + (number % folds)).cast("bigint")


def little_endian_fold(key: Column, folds: int) -> Column:
    """Variant that reads the first eight digest bytes with the lowest first."""
    h = F.sha2(key.cast("string"), 256)
    swapped = F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])
    return (F.conv(swapped, 16, 10).cast("decimal(20,0)") % folds).cast("bigint")


def complement(allele: Column) -> Column:
    """Complementary base; other letters give an empty text that matches nothing."""
    return F.when(allele.isin("A", "C", "G", "T"), F.translate(allele, "ACGT", "TGCA")).otherwise(F.lit(""))


def orient_alleles(cis_a: Column, cis_o: Column, trans_a: Column, trans_o: Column) -> Column:
    """+1 aligned, -1 swapped, both also on the other strand, else 0."""
    a, o, x, y = F.upper(cis_a), F.upper(cis_o), F.upper(trans_a), F.upper(trans_o)
    cx, cy = complement(x), complement(y)
    return (
        F.when((a == x) & (o == y), 1).when((a == y) & (o == x), -1)
        .when((a == cx) & (o == cy), 1).when((a == cy) & (o == cx), -1).otherwise(0)
    )


def is_palindromic(a: Column, b: Column) -> Column:
    return F.concat(F.upper(a), F.upper(b)).isin("AT", "TA", "CG", "GC")


def predicted_direction(effect: Column, cis_z: Column) -> Column:
    """Knockdown effect turned to the allele that raises the mediator."""
    return effect * -F.signum(cis_z)


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos, ref, alt)


def element_key(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start, F.lit("-"), end)


def pair_key(a: Column, b: Column, suffix: Column | None = None) -> Column:
    """Order-free pair id."""
    parts = F.array_sort(F.array(a, b))
    return F.concat_ws("|", parts, *([suffix] if suffix is not None else []))


def parse_members(df: DataFrame, column: str, keep: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """List literals such as "['g1_Rest', ...]" to distinct (keep, member, state)."""
    items = F.regexp_extract_all(column, F.lit(r"'([^']*)'"), 1)
    pattern = "^(.*)_(" + "|".join(suffixes) + ")$"
    cells = df.select(*keep, F.explode(items).alias("cell"))
    return cells.select(
        *keep, F.regexp_extract("cell", pattern, 1).alias("member"), F.regexp_extract("cell", pattern, 2).alias("state")
    ).filter(F.col("member") != "").distinct()


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def gc_fraction(sequence: Column) -> Column:
    s = F.upper(sequence)
    return F.try_divide(F.length(F.regexp_replace(s, "[^GC]", "")).cast("double"), F.length(s).cast("double"))


def strip_chr(c: Column) -> Column:
    return F.regexp_replace(c, "^chr", "")


def strip_alias(c: Column) -> Column:
    """Gene symbol without a trailing ``-n`` alias number."""
    return F.regexp_replace(F.upper(F.trim(c)), r"-\d+$", "")


def minmax_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scale to [0, 1]; a constant column gives NULL."""
    stats = df.groupBy(*by).agg(
        *[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns])
    scaled = [
        F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).alias(f"{c}_scaled") for c in columns
    ]
    return attach(df, stats, by).select(*df.columns, *scaled)


def scale_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The transforms used: one row per column with its minimum and maximum."""
    stats = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c)["lo"].alias("lo"), F.col(c)["hi"].alias("hi")) for c in columns])
    return stats.select(F.explode(rows).alias("x")).select("x.*")


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<c>_missing`` flags and exact-median fill."""
    out = df
    for c in columns:
        out = attach_scalar(out, exact_quantiles(df, [], c, {f"__m_{c}": 0.5}))
    return out.select(
        *[x for x in df.columns if x not in columns],
        *[F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")).alias(c) for c in columns],
        *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns],
    )
