"""Ranks, prefix sums and exact quantiles without one task per group.

A plain window puts a whole group into one task, which fails when a group (a
state, a family, the whole table) holds a large share of all rows. Here a group
above ``ROWS_PER_BUCKET`` rows is cut into ordered buckets at approximate
quantiles; each bucket is sorted on its own and shifted by the total of the
buckets before it. Results are exact: the sketch only places the cuts. Groups
below the limit keep a single bucket and behave like a plain window. When the counted
rows of the whole input are below the limit, the plain window is used at once;
both forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.hashing import digest
from statewise.session import cut_lineage, written

ROWS_PER_BUCKET = 1_000_000
FAN_OUT = 32  # two levels of 32 give 1,024 buckets per large group
_CUTS = FAN_OUT * FAN_OUT - 1
_FRACTIONS = "cast(split('" + ",".join(repr((i + 1) / (_CUTS + 1)) for i in range(_CUTS)) + "', ',') as array<double>)"


def fits_one_task(df: DataFrame, limit: int = ROWS_PER_BUCKET) -> bool:
    """Whether the counted rows of ``df`` bound every group of it.

    Counting stops just above the limit. ``limit`` other than the default asks
    for the bucketed form.
    """
    return limit == ROWS_PER_BUCKET and df.limit(limit + 1).count() <= limit


_HEAVY = ("Join", "Aggregate", "Window", "Generate", "InPandas", "GroupsIn")


def reread(df: DataFrame, compact: bool = False) -> DataFrame:
    """The input for operators that read it several times: a deep plan is
    written once to the checkpoint folder, a plain scan is left alone.

    ``compact`` is for many rows: a plan that only spreads the rows of a scan is left
    alone as well, and a deep one becomes a Parquet table, a fraction of a checkpoint.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if compact:
        return written(df, "kept") if any(word in plan for word in _HEAVY if word != "Generate") else df
    return cut_lineage(df) if any(word in plan for word in _HEAVY) else df


def settled(df: DataFrame, limit: int = ROWS_PER_BUCKET) -> tuple[DataFrame, bool]:
    """The input, ready to be read several times, and whether one task can hold it.

    A deep plan (joins, aggregations, generators) is written once to the
    checkpoint folder instead of being computed again for the count, the cuts, the
    shifts and the rows. The rows are counted, never estimated: file sizes say
    little about how many rows a compressed column or a generator holds.
    """
    if limit != ROWS_PER_BUCKET:
        return df, False
    kept = reread(df)
    return kept, fits_one_task(kept, limit)


def dealt(df: DataFrame, rows: int, *columns: str, limit: int = 1 << 19) -> DataFrame:
    """``df`` of so many ``rows`` by ``columns``, in partitions of about ``limit`` rows where the session's
    number of shuffle partitions would give larger ones; else as it is, and AQE decides."""
    parts = -(-rows // limit)
    return df.repartition(parts, *columns) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an aggregate that has exactly one row."""
    return df.crossJoin(F.broadcast(one_row))


def spread_over(df: DataFrame, listed: DataFrame, limit: int = 100_000) -> DataFrame:
    """Every row with every entry of a short list, for outputs that are that product.

    The list travels as one array whose length is checked (the query fails
    beyond ``limit``; split the list then), so rows expand where they are.
    """
    packed = listed.limit(limit + 1).agg(F.collect_list(F.struct(*listed.columns)).alias("__ord_l"))
    packed = packed.filter(F.assert_true(F.size("__ord_l") <= limit, F.lit("list too long to spread")).isNull())
    return attach_scalar(df, packed).select(*df.columns, F.explode("__ord_l").alias("__ord_x")).select(*df.columns, "__ord_x.*")


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    return df.join(stats, list(by), how) if by else attach_scalar(df, stats)


def _cut(df: DataFrame, by: Sequence[str], value: str, limit: int, shape: DataFrame | None = None) -> DataFrame:
    """Add bucket ``__ord_b``, whether the group was cut, ``__ord_big``, and a heavy-tie flag ``__ord_heavy``.

    Only groups above ``limit`` rows are cut, so their cuts are few (one list for
    every ``limit`` rows of the input at most) and are sent to the rows: a join
    on the group would bring a whole group into one task. ``shape`` places the
    cuts instead of the rows; it holds the value and some columns of ``by``.
    """
    shape = df if shape is None else shape
    keys = [c for c in by if c in shape.columns]
    profile = shape.groupBy(*keys).agg(
        F.count(value).alias("__ord_n"), F.percentile_approx(value, F.expr(_FRACTIONS), F.lit(4096)).alias("__ord_cuts"))
    if keys:
        out = df.join(F.broadcast(profile.filter(F.col("__ord_n") > limit).drop("__ord_n")), keys, "left")
    else:
        out = attach_scalar(df, profile.select(F.when(F.col("__ord_n") > limit, F.col("__ord_cuts")).alias("__ord_cuts")))
    v = F.col(value)
    whole = F.col("__ord_cuts").isNull() | v.isNull()
    # binary search for the number of cuts below the value, a step for each bit
    out = out.withColumn("__ord_b", F.lit(0))
    for step in (1 << bit for bit in reversed(range(_CUTS.bit_length()))):
        above = F.get("__ord_cuts", F.col("__ord_b") + (step - 1)) < v
        out = out.withColumn("__ord_b", F.col("__ord_b") + F.when(above, step).otherwise(0))
    # a draw below 1 adds 0; no rule of the optimizer writes the steps into each other across it
    out = out.withColumn("__ord_b", F.when(whole, 0).otherwise(F.col("__ord_b")) + F.rand(0).cast("int"))
    heavy = F.coalesce(F.get("__ord_cuts", F.col("__ord_b") + 1) == v, F.lit(False))
    return out.select(*df.columns, "__ord_b", F.col("__ord_cuts").isNotNull().alias("__ord_big"), heavy.alias("__ord_heavy"))


def _shift(df: DataFrame, by: Sequence[str], cells: Sequence[str], sums: Mapping[str, Column], whole: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Join per-cell totals of the cells before each (group, cell); ``whole`` names the group total of the first.
    ``counted`` holds the same rows of ``by`` and ``cells``, where they are cheaper to read."""
    totals = (df if counted is None else counted).groupBy(*by, *cells).agg(*[F.sum(c).alias(f"__ord_o_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    group = [F.sum(f"__ord_o_{next(iter(sums))}").over(Window.partitionBy(*by)).alias(whole)] if whole else []
    shifts = totals.select(
        *by, *cells, *group, *[F.coalesce(F.sum(f"__ord_o_{k}").over(before), F.lit(0)).alias(f"__ord_o_{k}") for k in sums]
    )
    return df.join(shifts, [*by, *cells])


def prefix_sums(
    df: DataFrame, by: Sequence[str], value: str, measures: Sequence[str], limit: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``before_<m>``: sum of ``m`` over smaller values of the group.

    ``df`` holds one row per (group, value), so ties are already merged.
    """
    df, small = settled(df, limit)
    if small:
        before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"before_{m}") for m in measures])
    cut = _shift(_cut(df, by, value, limit), by, ["__ord_b"], {m: F.col(m) for m in measures})
    local = Window.partitionBy(*by, "__ord_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cut.select(
        *df.columns,
        *[(F.coalesce(F.sum(m).over(local), F.lit(0)) + F.col(f"__ord_o_{m}")).alias(f"before_{m}") for m in measures],
    )


def running_extreme(df: DataFrame, by: Sequence[str], value: str, measures: Mapping[str, str], largest: bool,
                    descending: bool, limit: int = ROWS_PER_BUCKET) -> DataFrame:
    """Running minimum or maximum of each measure, this row included.

    ``measures`` maps input to output columns; ``descending`` runs from the
    largest value down.
    """
    pick, merge = (F.max, F.greatest) if largest else (F.min, F.least)
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    df, small = settled(df, limit)
    if small:
        so_far = Window.partitionBy(*by).orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[pick(m).over(so_far).alias(out) for m, out in measures.items()])
    cut = _cut(df, by, value, limit)
    earlier = Window.partitionBy(*by).orderBy(order("__ord_b")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cut.groupBy(*by, "__ord_b").agg(*[pick(m).alias(f"__ord_m_{m}") for m in measures])
    cells = cells.select(*by, "__ord_b", *[pick(f"__ord_m_{m}").over(earlier).alias(f"__ord_m_{m}") for m in measures])
    local = Window.partitionBy(*by, "__ord_b").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(cells, [*by, "__ord_b"]).select(
        *df.columns, *[merge(pick(m).over(local), F.col(f"__ord_m_{m}")).alias(out) for m, out in measures.items()])


def suffix_min(df: DataFrame, by: Sequence[str], value: str, measure: str, out: str,
               limit: int = ROWS_PER_BUCKET) -> DataFrame:
    """Minimum of ``measure`` over this and all larger values of the group."""
    return running_extreme(df, by, value, {measure: out}, largest=False, descending=True, limit=limit)


def tie_groups(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per (group, value) with its count and the count before it."""
    ties = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    return prefix_sums(ties, by, value, ["ties"])


def rank_average(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank (ties share the mean of their positions); NULL stays NULL."""
    df, small = settled(df)
    if small:
        lower = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
        return df.select("*", F.when(F.col(value).isNotNull(), lower + (ties - 1) / 2.0).alias(out))
    ranks = tie_groups(df, by, value).select(
        *by, value, (F.col("before_ties") + (F.col("ties") + 1) / 2.0).alias(out)
    )
    return df.join(ranks, [*by, value], "left").select(*df.columns, out)


def rank_first(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    key: Sequence[str],
    out: str,
    n_out: str | None = None,
    limit: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1-based position by (value, md5 of the key, key); NULL values get NULL.

    Breaking ties by a hash lets one heavily repeated value be spread over many
    tasks: its rows split by hash prefix and keep the same total order.
    """
    df, small = settled(df, limit)
    work = df.withColumn("__ord_h", digest(*[F.col(k) for k in key]))
    if small:
        whole = Window.partitionBy(*by)
        position = F.row_number().over(whole.orderBy(F.col(value).asc_nulls_last(), "__ord_h", *key)).cast("bigint")
        size = [F.count(value).over(whole).alias(n_out)] if n_out else []
        return work.select(*df.columns, F.when(F.col(value).isNotNull(), position).alias(out), *size)
    work = _cut(work, by, value, limit)
    prefix = F.conv(F.substring("__ord_h", 1, 2), 16, 10).cast("int")
    present = F.col(value).isNotNull()
    spread = F.when(F.col("__ord_heavy"), prefix + 1).when(~present, -prefix - 1).otherwise(0)
    work = work.withColumn("__ord_s", spread)
    work = _shift(work, by, ["__ord_b", "__ord_s"], {"c": present.cast("bigint")}, "__ord_n")
    local = Window.partitionBy(*by, "__ord_b", "__ord_s").orderBy(F.col(value).asc_nulls_last(), "__ord_h", *key)
    position = F.when(present, F.row_number().over(local) + F.col("__ord_o_c"))
    cols = [*df.columns, position.cast("bigint").alias(out)]
    return work.select(*cols, *([F.col("__ord_n").alias(n_out)] if n_out else []))


def hash_rank(
    df: DataFrame, by: Sequence[str], hashed: str | Column, key: Sequence[str], out: str, size: str | None = None,
    limit: int = ROWS_PER_BUCKET, n_out: str | None = None, ahead: Mapping[str, str] | None = None, opens: str | None = None,
) -> DataFrame:
    """0-based position inside the group by (hash, key).

    Hashes are uniform, so their prefix gives even buckets without a sketch.
    ``size`` names a column with the group size; without it every group is cut.
    ``n_out`` adds the size of the group. A ``hashed`` expression is worked out again where
    the rows have met, so no digest is shuffled. ``ahead`` names columns that take those of the row
    at the next position, null for the last of a bucket, and ``opens`` one that marks a bucket's first.
    """
    prefix = F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int")
    bucket = F.when(F.col(size) > limit, prefix).otherwise(0) if size else prefix
    # numbered before they meet the shifts: the join then finds its rows in order and sorts them no second time
    work = counted = df.withColumn("__ord_b", bucket)
    if isinstance(hashed, Column):
        work, hashed = work.repartition(*by, "__ord_b").withColumn("__ord_h", hashed), "__ord_h"
    local = Window.partitionBy(*by, "__ord_b").orderBy(hashed, *key)
    work = work.withColumns({"__ord_r": F.row_number().over(local), **{n: F.lead(c).over(local) for c, n in (ahead or {}).items()}})
    work = _shift(work, by, ["__ord_b"], {"c": F.lit(1)}, "__ord_n", counted)
    return work.select(*df.columns, (F.col("__ord_r") - 1 + F.col("__ord_o_c")).cast("bigint").alias(out),
                       *([F.col("__ord_n").alias(n_out)] if n_out else []), *(ahead or {}).values(),
                       *([(F.col("__ord_r") == 1).alias(opens)] if opens else []))


def unit_index(units: DataFrame, key: Sequence[str], by: Sequence[str] = (), out: str = "idx",
               n_out: str = "n_units", limit: int = ROWS_PER_BUCKET) -> DataFrame:
    """Number the (distinct) units of each group 0..n-1 in md5 order and add n."""
    units, small = settled(units, limit)
    if small:
        whole = Window.partitionBy(*by)
        hashed = units.withColumn("__ord_h", digest(*[F.col(k) for k in key]))
        number = (F.row_number().over(whole.orderBy("__ord_h", *key)) - 1).cast("bigint")
        return hashed.select(*units.columns, F.count(F.lit(1)).over(whole).alias(n_out), number.alias(out))
    hashed = units.withColumn("__ord_h", digest(*[F.col(k) for k in key]))
    if not by:
        return hash_rank(hashed, by, "__ord_h", key, out, n_out=n_out).drop("__ord_h")
    # the sizes of large groups are few; a join with all sizes would bring a group into one task
    large = units.groupBy(*by).agg(F.count(F.lit(1)).alias("__ord_size")).filter(F.col("__ord_size") > limit)
    hashed = hashed.join(F.broadcast(large), list(by), "left")
    return hash_rank(hashed, by, "__ord_h", key, out, "__ord_size", limit, n_out).drop("__ord_h", "__ord_size")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], limit: int = ROWS_PER_BUCKET,
    weight: str | None = None, shape: DataFrame | None = None, again: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one output column per name.

    Rows are counted by bucket where they are; only the buckets that hold a wanted
    position are sorted. ``weight`` repeats a value. ``shape`` places the cuts (see
    ``_cut``) where the rows are many copies of it. ``again``: the rows are cheap to compute
    again and are not written first.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__ord_v"), *([F.col(weight).cast("bigint").alias("__ord_w")] if weight else []))
    rows = rows.filter(F.col("__ord_v").isNotNull())
    rows, small = (rows, fits_one_task(rows, limit)) if again else settled(rows, limit)
    if small and not weight:
        found = rows.groupBy(*by).agg(*[F.percentile("__ord_v", float(p)).alias(n) for n, p in probs.items()])
        return found
    if shape is not None:
        shape = shape.select(*[c for c in by if c in shape.columns], F.col(value).cast("double").alias("__ord_v"))
    if small:
        cut = rows.select("*", F.lit(0).alias("__ord_b"), F.lit(False).alias("__ord_big"))
    else:
        cut = _cut(rows, by, "__ord_v", limit if shape is None else limit // 16, shape).drop("__ord_heavy")
    size = F.sum("__ord_w") if weight else F.count(F.lit(1))
    cells = Window.partitionBy(*by)
    before = cells.orderBy("__ord_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*by, "__ord_b", "__ord_big").agg(size.alias("__ord_c")).select(
        "*", F.sum("__ord_c").over(cells).alias("__ord_n"), F.coalesce(F.sum("__ord_c").over(before), F.lit(0)).alias("__ord_o"))

    def edge(p: float, upper: bool) -> Column:
        spot = (F.col("__ord_n") - 1) * F.lit(float(p))
        return (F.ceil(spot) if upper else F.floor(spot)).cast("bigint")

    spots = F.array(*[edge(p, u) for p in probs.values() for u in (False, True)])
    wanted = counts.filter(
        F.exists(spots, lambda s: (s >= F.col("__ord_o")) & (s < F.col("__ord_o") + F.col("__ord_c")))
    ).select(*by, "__ord_b", "__ord_big", "__ord_o", "__ord_n")
    # groups that were cut are few, and so are their wanted buckets
    hits = wanted.filter("__ord_big").select(*by, "__ord_b", F.lit(True).alias("__ord_hit"))
    near = cut.join(F.broadcast(hits), [*by, "__ord_b"], "left").filter(F.col("__ord_hit") | ~F.col("__ord_big"))
    ties = near.groupBy(*by, "__ord_b", "__ord_v").agg(size.alias("__ord_t")).join(wanted.drop("__ord_big"), [*by, "__ord_b"])
    local = Window.partitionBy(*by, "__ord_b").orderBy("__ord_v").rowsBetween(Window.unboundedPreceding, 0)
    ties = ties.withColumn("__ord_hi", F.sum("__ord_t").over(local) + F.col("__ord_o"))
    picks = []
    for name, p in probs.items():
        for side in (False, True):
            inside = (edge(p, side) < F.col("__ord_hi")) & (edge(p, side) >= F.col("__ord_hi") - F.col("__ord_t"))
            picks.append(F.max(F.when(inside, F.col("__ord_v"))).alias(f"__ord_{name}_{int(side)}"))
    got = ties.groupBy(*by).agg(F.max("__ord_n").alias("__ord_n"), *picks)
    out = []
    for name, p in probs.items():
        spot = (F.col("__ord_n") - 1) * F.lit(float(p))
        low, high = F.col(f"__ord_{name}_0"), F.col(f"__ord_{name}_1")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return got.select(*by, *out)


def median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, by, value, {out: 0.5})


def weighted_quantiles(df: DataFrame, by: Sequence[str], value: str, weight: str, probs: Mapping[str, float],
                       shape: DataFrame | None = None, again: bool = False) -> DataFrame:
    """Quantiles of the sample in which each value is repeated ``weight`` times."""
    return exact_quantiles(df, by, value, probs, weight=weight, shape=shape, again=again)
