"""Incremental scans of arriving files.

Every micro-batch runs the batch operators on its rows and writes one small
counter table per batch id, overwriting on retry, so results are exactly once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewise.functions.ordering import attach_scalar
from statewise.operators.contracts import gwas_counts, gwas_flags, order_violations


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _drain(stream: DataFrame, work: str, each) -> None:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_quality_scan(stream: DataFrame, work: str) -> DataFrame:
    """Association counters over all arrived files."""

    def each(batch: DataFrame, batch_id: int) -> None:
        flagged = gwas_flags(batch)
        flagged.agg(*gwas_counts()).write.mode("overwrite").parquet(f"{work}/counts/batch={batch_id}")

    _drain(stream, work, each)
    counts = stream.sparkSession.read.parquet(f"{work}/counts")
    names = [c for c in counts.columns if c != "batch"]
    return counts.agg(*[F.sum(c).alias(c) for c in names])


def stream_order_check(stream: DataFrame, position: str, coordinate: str, key: Sequence[str], work: str) -> DataFrame:
    """Order violations and repeated keys, also across batch borders.

    A batch is checked in blocks by the batch operator. What crosses batches is
    small: the last coordinate so far, and the keys seen at it (as in a sorted
    source, repeats across a border share the border coordinate).
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        inside = order_violations(batch, position, coordinate)
        ends = batch.agg(F.min_by(coordinate, position).alias("first_c"), F.max_by(coordinate, position).alias("last_c")).first()
        carried = spark.read.parquet(f"{work}/tail/batch={batch_id - 1}") if batch_id > 0 else None
        if ends["first_c"] is None:  # nothing arrived: what was carried goes on
            kept = carried if carried is not None else batch.select(F.col(coordinate).alias("c"), *key).limit(0)
            kept.write.mode("overwrite").parquet(f"{work}/tail/batch={batch_id}")
            nothing = [F.lit(0).cast("long").alias(c) for c in ("order_violations", "duplicate_keys", "rows")]
            spark.range(1).select(*nothing).write.mode("overwrite").parquet(f"{work}/counts/batch={batch_id}")
            batch.unpersist()
            return
        seam = 0
        if carried is not None:
            before = carried.agg(F.max("c")).first()[0]
            seam = int(before is not None and ends["first_c"] < before)
        repeated = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_keys"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows"))
        row = attach_scalar(inside, repeated).withColumn("order_violations", F.col("order_violations") + seam)
        if carried is not None:
            shared = carried.select(*key).distinct().join(batch.select(*key).distinct(), list(key), "left_semi").agg(F.count(F.lit(1)).alias("shared"))
            row = attach_scalar(row, shared).withColumn("duplicate_keys", F.col("duplicate_keys") + F.col("shared")).drop("shared")
        row.write.mode("overwrite").parquet(f"{work}/counts/batch={batch_id}")
        tail = batch.filter(F.col(coordinate) == F.lit(ends["last_c"])).select(F.col(coordinate).alias("c"), *key).distinct()
        tail.write.mode("overwrite").parquet(f"{work}/tail/batch={batch_id}")
        batch.unpersist()

    _drain(stream, work, each)
    return spark.read.parquet(f"{work}/counts").agg(*[F.sum(c).alias(c) for c in ("order_violations", "duplicate_keys", "rows")])


def stream_semi_filter(stream: DataFrame, keys: dict[str, DataFrame], work: str) -> DataFrame:
    """Rows of arriving files whose columns are in the static key tables."""
    kept = stream
    for column, table in keys.items():
        kept = kept.join(table.select(F.col(table.columns[0]).alias(column)).distinct(), column, "left_semi")
    query = kept.writeStream.format("parquet").option("path", f"{work}/rows").option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(kept.schema).parquet(f"{work}/rows")


# ---- keyed state --------------------------------------------------------------------------

def run_summaries(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each group of a run of rows (g, p, c, k): its ends, its violations and its repeats.

    A repeat is a key that its stretch of equal coordinates has had. ``first_keys`` and
    ``last_keys`` are the keys of the first and last stretch; ``level`` says that they are one.
    """
    rows = rows.sort_values(["g", "p"], kind="stable")
    same = rows["g"].eq(rows["g"].shift())
    rows = rows.assign(bad=same & (rows["c"] < rows["c"].shift()), s=(~same | (rows["c"] != rows["c"].shift())).cumsum())
    rows["again"] = rows.duplicated(["s", "k"])
    out = []
    for g, x in rows.groupby("g", sort=False):
        first, last = x["c"].iloc[0], x["c"].iloc[-1]
        ends = x["s"].iloc[0], x["s"].iloc[-1]
        keys = [json.dumps(sorted(set(x["k"][x["s"] == s]))) for s in ends]
        out.append((g, x["p"].iloc[0], first, last, int(x["bad"].sum()), int(x["again"].sum()), len(x), *keys, ends[0] == ends[1]))
    return pd.DataFrame(out, columns=["g", "p", "first", "last", "bad", "again", "rows", "first_keys", "last_keys", "level"])


def merged_state(state: tuple | None, runs: pd.DataFrame) -> tuple:
    """State (last coordinate, keys at it, violations, repeats, rows) of a group after further runs."""
    last, keys, bad, again, rows = state or (None, "[]", 0, 0, 0)
    for r in runs.sort_values("p").itertuples():
        here = json.loads(r.last_keys)
        if last is not None:
            bad += int(r.first < last)
            if r.first == last:
                known = set(json.loads(keys))
                again += len(known & set(json.loads(r.first_keys)))
                if r.level:
                    here = sorted(known | set(here))
        last, keys = int(r.last), json.dumps(here)
        bad, again, rows = bad + int(r.bad), again + int(r.again), rows + int(r.rows)
    return last, keys, bad, again, rows


def stream_group_check(stream: DataFrame, group: str, position: str, coordinate: str, key: Sequence[str], work: str) -> DataFrame:
    """Order violations and repeats at a coordinate, for each group (a chromosome) of a stream in file order.

    Tasks sum up the runs of rows that they read, so rows are never shuffled; a run's ends meet
    the group's state, which Spark keeps and recovers with the stream. Groups may
    interleave and come back in later files. Within a group, files and their rows arrive in
    the order of ``position``. Columns: the group, order_violations, duplicate_keys, rows.
    """
    spark = stream.sparkSession
    kind = stream.schema[group].dataType.simpleString()
    rows = stream.select(F.col(group).alias("g"), F.col(position).cast("long").alias("p"), F.col(coordinate).cast("long").alias("c"), F.to_json(F.struct(*key)).alias("k"))

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield run_summaries(frame)

    def update(name, frames, state):
        after = merged_state(state.get if state.exists else None, pd.concat(list(frames), ignore_index=True))  # a row for each run of the batch
        state.update(after)
        yield pd.DataFrame([(name[0], *after[2:])], columns=["g", "order_violations", "duplicate_keys", "rows"])

    summed = rows.mapInPandas(runs, f"g {kind}, p long, first long, last long, bad long, again long, rows long, first_keys string, last_keys string, level boolean")
    totals = summed.groupBy("g").applyInPandasWithState(
        update, f"g {kind}, order_violations long, duplicate_keys long, rows long", "last long, keys string, bad long, again long, rows long", "update", "NoTimeout")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/totals/batch={batch_id}")

    query = totals.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    latest = spark.read.parquet(f"{work}/totals").groupBy("g").agg(F.max_by(F.struct("order_violations", "duplicate_keys", "rows"), "batch").alias("t"))
    return latest.select(F.col("g").alias(group), "t.*")
