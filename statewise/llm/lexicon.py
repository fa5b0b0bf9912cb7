"""Sums over the units of a document of a value that a corpus-wide table has for each unit.

Units (pre-tokens, words) follow a heavy-tailed law. The most frequent ones, a
fixed number, travel to all tasks and are summed where the document is read.
All other units go through one equality join; none of them is frequent, so no
key of that join is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_UNITS = 1 << 17  # entries sent to every task: a few MB at any corpus size
FLUSH_UNITS = 200_000  # distinct units that a task holds before it hands them on


def unit_counts(texts: DataFrame, units: Callable[[Iterator], Iterator], kind: str = "string") -> DataFrame:
    """(unit, n): occurrences over all rows of ``texts``; counted in each task first.

    ``units`` takes the Arrow batches of a task and yields, each time it holds
    about ``FLUSH_UNITS`` entries, counts of units, counts of larger strings and
    a function that gives the units of such a string.
    """

    def count(batches):
        for counts, larger, of in units(batches):
            total = dict(counts)
            for string, n in larger.items():
                for unit in of(string):
                    total[unit] = total.get(unit, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string() if kind == "string" else pa.binary()), pa.array(list(total.values()), type=pa.int64())], names=["unit", "n"])

    return texts.mapInArrow(count, f"unit {kind}, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(lexicon: DataFrame, value: str, limit: int = HOT_UNITS) -> dict:
    """The ``limit`` most frequent units and their values; ties by unit."""
    top = lexicon.orderBy(F.desc("n"), "unit").limit(limit).select("unit", value)
    hot: dict = {}
    for batch in top.toArrow().to_batches():
        hot.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    return hot


def by_row(long: DataFrame, lexicon: DataFrame, sums: dict, carried: list[str]) -> DataFrame:
    """One row for each ``_row`` of ``long``.

    ``long`` has rows (_row, unit, n, carried...): rare units of a document with
    null carried columns, and one base row for each document whose unit is null.
    ``sums`` maps a result column to an expression over ``n`` and the lexicon's
    columns, null on base rows; base rows hold the part of the hot units under
    the same name. Base rows have no unit, so they get join keys of their own
    and don't meet in one task.
    """
    key = F.coalesce(F.col("unit"), F.concat(F.lit("\x00 "), F.col("_row").cast("string")).cast(dict(long.dtypes)["unit"]))
    met = long.withColumn("_key", key).join(lexicon.withColumnRenamed("unit", "_key"), "_key", "left")
    return met.groupBy("_row").agg(
        *[F.max(F.when(F.col("unit").isNull(), F.struct(*carried))).alias("_base")],
        *[F.sum(F.when(F.col("unit").isNull(), F.col(name)).otherwise(expression)).alias(name) for name, expression in sums.items()],
    )
