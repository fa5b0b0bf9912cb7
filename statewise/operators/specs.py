"""Specification grids: every combination as rows, every failure kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewise.functions.ordering import spread_over


def spec_grid(spark: SparkSession, dims: Mapping[str, Sequence], limit: int = 1_000_000) -> DataFrame:
    """Cartesian specifications numbered in row-major order of the dimensions.

    Built by arithmetic on the id, so no dimension tables are multiplied.
    """
    total = 1
    for v in dims.values():
        total *= len(v)
    if total > limit:
        raise ValueError(f"{total} specifications")
    out, stride = spark.range(total).withColumnRenamed("id", "spec_id"), total
    for name, values in dims.items():
        stride //= len(values)
        listed = F.array(*[F.lit(v) for v in values])
        out = out.withColumn(name, F.element_at(listed, (F.floor(F.col("spec_id") / stride) % len(values) + 1).cast("int")))
    return out


def run_specs(df: DataFrame, unit: str, outcome: str, filters: Mapping[str, Mapping[str, Column]], by: Sequence[str] = (), minimum: int = 2) -> DataFrame:
    """Mean of unit means under every combination of row filters.

    ``filters`` maps a dimension to {label: predicate}. Rows first collapse to
    one row per unit and membership pattern; only those partial sums fan out to
    the specifications they belong to. Specifications without enough units stay
    as unavailable rows.
    """
    member = {d: F.filter(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(label)) for label, p in levels.items()]), lambda x: x.isNotNull()) for d, levels in filters.items()}
    cells = df.filter(F.col(outcome).isNotNull()).groupBy(*by, unit, *[c.alias(d) for d, c in member.items()]).agg(F.sum(outcome).alias("s"), F.count(F.lit(1)).alias("c"))
    for d in filters:
        cells = cells.withColumn(d, F.explode(d))
    per = cells.groupBy(*by, *filters, unit).agg((F.sum("s") / F.sum("c")).alias("m"), F.sum("c").alias("rows"))
    est = per.groupBy(*by, *filters).agg(F.count(F.lit(1)).alias("units"), F.sum("rows").alias("rows"), F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    grid = spec_grid(df.sparkSession, {d: list(levels) for d, levels in filters.items()})
    scopes = df.select(*by).distinct() if by else None
    full = spread_over(scopes, grid) if by else grid
    j = full.join(est, [*by, *filters], "left")
    enough = F.coalesce(F.col("units") >= minimum, F.lit(False))
    return j.select(
        "spec_id", *by, *filters, F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("rows", F.lit(0)).alias("rows"), F.when(enough, F.col("mean")).alias("estimate"),
        F.when(enough, F.col("se")).alias("se"), F.when(enough, "estimated").otherwise("unavailable").alias("status"), F.when(enough, "").otherwise("too_few_units").alias("reason"))


def family_summary(specs: DataFrame, family: Sequence[str], estimate: str = "estimate", q: str = "q", level: float = 0.05) -> DataFrame:
    """Direction share, q-support share, range and robustness label per family."""
    e = F.col(estimate)
    s = specs.groupBy(*family).agg(
        F.count(F.lit(1)).alias("specifications"), F.count(e).alias("estimable"), F.sum((e > 0).cast("bigint")).alias("pos"), F.sum((e < 0).cast("bigint")).alias("neg"),
        F.sum((F.col(q) < level).cast("bigint")).alias("sup"), F.min(e).alias("minimum"), F.max(e).alias("maximum"))
    n = F.col("estimable").cast("double")
    s = s.withColumns({"direction_share": F.try_divide(F.greatest("pos", "neg").cast("double"), n), "support_share": F.try_divide(F.coalesce("sup", F.lit(0)).cast("double"), n)})
    label = (F.when(F.col("estimable") == 0, "unavailable").when((F.col("direction_share") >= 0.80) & (F.col("support_share") >= 0.50), "broad")
             .when(F.col("direction_share") >= 0.60, "mixed").otherwise("narrow"))
    return s.withColumn("robustness", label).drop("pos", "neg", "sup")


def merge_shards(shards: Sequence[DataFrame], expected: int, key: str = "spec_id") -> tuple[DataFrame, DataFrame]:
    """Union of shards plus the audit: repeated, missing and unexpected ids."""
    merged = shards[0]
    for s in shards[1:]:
        merged = merged.unionByName(s)
    seen = merged.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    wanted = merged.sparkSession.range(expected).withColumnRenamed("id", key).withColumn("w", F.lit(1))
    audit = seen.join(wanted, key, "full_outer").agg(
        F.coalesce(F.sum((F.col("c") > 1).cast("bigint")), F.lit(0)).alias("repeated"), F.sum(F.col("c").isNull().cast("bigint")).alias("missing"), F.sum(F.col("w").isNull().cast("bigint")).alias("unexpected"))
    return merged, audit
