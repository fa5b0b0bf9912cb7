"""Result sink with read-back checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(
    df: DataFrame, path: str, fmt: str = "parquet", keys: Sequence[str] = (), partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` range-sorted by its keys, read it back and check it.

    The row count is observed during the write, so the input is computed once.
    Returns the table as read back.
    """
    from pyspark.sql import Observation

    # Observe after the range exchange: the exchange samples its input, which would count rows twice.
    seen = Observation()
    if keys:
        df = df.repartitionByRange(*[F.col(k) for k in keys])
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if keys:
        observed = observed.sortWithinPartitions(*keys)
    writer = observed.write.mode("errorifexists").format("csv" if fmt == "tsv" else fmt)
    if fmt in ("csv", "tsv"):
        writer = writer.option("header", "true").option("sep", "\t" if fmt == "tsv" else ",")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    spark = df.sparkSession
    reader = spark.read.schema(df.schema)
    if fmt in ("csv", "tsv"):
        reader = reader.option("header", "true").option("sep", "\t" if fmt == "tsv" else ",")
    back = reader.format("csv" if fmt == "tsv" else fmt).load(path)
    checks = [F.count(F.lit(1)).alias("rows")]
    if keys:
        per_key = back.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        rows, repeated = per_key.agg(
            F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 1).cast("int")), F.lit(0))
        ).first()
    else:
        rows, repeated = back.agg(*checks).first()[0], 0
    if rows != seen.get["rows"] or repeated:
        raise ValueError(f"read-back found {rows} rows, wrote {seen.get['rows']}, {repeated} repeated keys")
    return back
