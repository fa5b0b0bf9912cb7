"""Exact nearest-neighbour joins, matched controls and their null."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions.hashing import draw, replicates
from statewise.functions.ordering import attach, attach_scalar, exact_quantiles, reread
from statewise.session import cut_lineage

BLOCK = 4096


PIVOT_CELLS = 1 << 22  # numbers in the table of pivots that every task gets (32 MB)
FIRST_CELLS = 2
WIDE = 2 * BLOCK  # rows of a block where every block meets every other
SENDING = 64  # pairs compared in the time that sends a row
SENT_NUMBERS = 1 << 30  # numbers in all visits (8 GB); beyond it blocks meet if they send less
SLICE = 256  # queries of a block compared at a time
PLACED = 1024  # rows held against all pivots at a time
SENT = 16384  # visits of a frame, and pairs whose distance is taken at a time


def pivots_of(rows: DataFrame, count: int) -> np.ndarray:
    """``count`` distinct vectors of (key, v) rows, by hash of the key; they only steer speed."""
    got = rows.select(F.xxhash64("key").alias("h"), "v").orderBy("h", "v").limit(4 * count).collect()
    points = np.unique(np.array([r.v for r in got], dtype=float), axis=0) if got else np.zeros((0, 0))
    return points[np.random.default_rng(5).permutation(len(points))[:count]]


def blocked_knn(
    queries: DataFrame, candidates: DataFrame, by: Sequence[str], query: str, candidate: str, features: Sequence[str] | str,
    k: int, block: int = BLOCK, skip_self: bool = False, within: float | None = None, counter: Accumulator | None = None,
) -> DataFrame:
    """The k nearest candidates of each query by Euclidean distance, exactly.

    Candidates lie in the cells of their nearest pivots; a cell knows the least and
    greatest distance to its pivot. A query first meets its nearest cells, and then, with
    the distance of its k-th find as bound, only cells that the triangle inequality does not
    rule out. Rows of a cell and the queries that come to it meet in blocks of bounded
    size. Where the counted visits cost more than all blocks meeting all blocks would
    (in high dimensions hardly a cell is ruled out), the blocks meet instead, and each query
    keeps the bound of its first visits. Ties break by candidate. ``features`` is a list of numeric columns or the
    name of an array column; ``within`` gives up rows farther away; ``counter`` adds
    up the pairs of rows compared.
    """
    vector = F.col(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    vector = vector.cast("array<double>")
    asked = reread(queries.select(*by, F.col(query).alias("query"), vector.alias("v")).filter(F.col("v").isNotNull()))
    held = reread(candidates.select(*by, F.col(candidate).alias("candidate"), vector.alias("v")).filter(F.col("v").isNotNull()))
    n, width = held.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return asked.select(*by, "query", F.lit(None).cast(held.schema["candidate"].dataType).alias("candidate"), F.lit(0.0).alias("distance"), F.lit(0).alias("slot")).limit(0)
    points = pivots_of(held.select(F.col("candidate").alias("key"), "v"), max(1, min(int(n**0.5), PIVOT_CELLS // max(width, 1))))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    ckind = held.schema["candidate"].dataType.simpleString()
    columns = [*by]

    def away(v) -> np.ndarray:
        x = np.stack(v.to_numpy())
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ points.T + (points * points).sum(1), 0))

    def placed(frames):
        for whole in frames:
            for start in range(0, len(whole), PLACED):
                f = whole.iloc[start:start + PLACED]
                d = away(f["v"])
                cell = d.argmin(axis=1)
                yield f.assign(cell=cell.astype("int32"), off=d[np.arange(len(f)), cell])

    schema = lambda extra: ", ".join([*(f"`{b}` {kinds[b]}" for b in by), *extra])
    held = cut_lineage(held.mapInPandas(placed, schema([f"candidate {ckind}", "v array<double>", "cell int", "off double"])))
    near, far = np.full(len(points), np.inf), np.full(len(points), -np.inf)
    for r in held.groupBy("cell").agg(F.min("off").alias("a"), F.max("off").alias("z")).collect():  # one row for each pivot
        near[r.cell], far[r.cell] = r.a, r.z

    def goes(whole: pd.DataFrame, first: bool):
        """Pieces of ``whole`` and which of its rows go to which cell."""
        for start in range(0, len(whole), PLACED):
            f = whole.iloc[start:start + PLACED]
            d = away(f["v"])
            slack = 1e-7 * (1 + d)  # of the distances as computed
            nearest = np.argsort(d, axis=1, kind="stable")[:, :FIRST_CELLS]
            go = np.zeros(d.shape, bool)
            go[np.arange(len(f))[:, None], nearest] = True
            if not first:
                least = np.maximum(d - far, near - d) - slack
                go = ~go & (least <= f["bound"].to_numpy()[:, None])
            yield f, go

    def visits(first: bool):
        def run(frames):
            for whole in frames:
                for f, go in goes(whole, first):
                    i, c = np.nonzero(go)
                    for at in range(0, len(i), SENT):
                        yield f.iloc[i[at:at + SENT]][[*columns, "query", "v", "bound"]].assign(cell=c[at:at + SENT].astype("int32"))
        return run

    def counted(frames):
        for whole in frames:
            for _, go in goes(whole, False):
                yield pd.DataFrame({"visits": [int(go.sum())]})

    visit = schema([f"query {kinds['query']}", "v array<double>", "bound double", "cell int"])
    cells = [*by, "cell"]
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fixed = [*by]

    def closest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(c) == 0:
            return pd.DataFrame({**{b: [] for b in fixed}, "query": [], "candidate": [], "distance": []})
        if counter is not None:
            counter.add(len(q) * len(c))
        c = c.sort_values("candidate", kind="stable")
        x, y = np.stack(q["v"].to_numpy()), np.stack(c["v"].to_numpy())
        sound = np.isfinite(y).all(axis=1)  # no other row has a finite distance
        own, names, bound, y = q["query"].to_numpy(), c["candidate"].to_numpy()[sound], q["bound"].to_numpy(), y[sound]
        if not len(names):
            return closest(q[:0], c)
        take = min(k + int(skip_self), len(names))
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        slack = 1e-11 * (1 + x.shape[1]) * (xx + yy.max())  # of the squares from a product
        parts = []
        for at in range(0, len(own), SLICE):
            some = slice(at, at + SLICE)
            square = xx[some, None] + yy - 2 * (x[some] @ y.T)
            edge = np.partition(square, take - 1, axis=1)[:, take - 1]
            i, j = np.nonzero(square <= (edge + 2 * slack[some])[:, None])
            i += at
            d = np.concatenate([np.zeros(0), *[np.sqrt(((y[j[p:p + SENT]] - x[i[p:p + SENT]]) ** 2).sum(axis=1)) for p in range(0, len(i), SENT)]])
            use = np.isfinite(d) & (d <= bound[i] * (1 + 1e-12))
            if skip_self:
                use &= names[j] != own[i]
            i, j, d = i[use], j[use], d[use]
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            i, j, d = i[place < k], j[place < k], d[place < k]
            parts.append(pd.DataFrame({"query": own[i], "candidate": names[j], "distance": d}))
        out = pd.concat(parts, ignore_index=True)
        for b in fixed:
            out.insert(0, b, q[b].iloc[0])
        return out[[*fixed, "query", "candidate", "distance"]]

    def met(coming: DataFrame, held: DataFrame, block: int) -> DataFrame:
        blocks = F.ceil(F.count(F.lit(1)) / block).cast("int")
        sizes = coming.groupBy(*cells).agg(blocks.alias("nq")).join(held.groupBy(*cells).agg(blocks.alias("nc")), cells)
        left = coming.join(sizes, cells).select(*cells, "query", "v", "bound", spread("query", "nq").alias("qb"), span("nc").alias("cb"))
        # The right side gets new column names: a self-cogroup cannot tell equal ones apart.
        right = held.join(sizes, cells).select(*[F.col(c).alias(f"__{c}") for c in cells], "candidate", "v", spread("candidate", "nc").alias("__cb"), span("nq").alias("__qb"))
        keys = [*cells, "qb", "cb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*[f"__{c}" for c in keys])).applyInPandas(
            closest, schema([f"query {kinds['query']}", f"candidate {ckind}", "distance double"]))

    order = Window.partitionBy(*by, "query").orderBy("distance", "candidate")
    best = lambda df: df.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= k)
    limit = F.lit(float("inf") if within is None else float(within))
    close = lambda df: df if within is None else df.filter(F.col("distance") <= within)
    found = cut_lineage(best(met(cut_lineage(asked.withColumn("bound", limit).mapInPandas(visits(True), visit)), held, block)))
    if len(points) <= FIRST_CELLS:
        return close(found)
    bound = found.groupBy(*by, "query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_d"))
    left = cut_lineage(asked.join(bound, [*by, "query"], "left").select(*by, "query", "v", F.least(F.coalesce("_d", limit), limit).alias("bound")))
    every = F.lit(0).alias("cell")
    groups = lambda df, n: df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias(n))
    both = attach(groups(left, "a"), groups(held, "b"), by)
    wide = max(block, WIDE)
    sent, pairs = both.agg(F.sum(F.col("a") * F.ceil(F.col("b") / wide) + F.col("b") * F.ceil(F.col("a") / wide)), F.sum(F.col("a") * F.col("b"))).first()
    count = left.mapInPandas(counted, "visits long").agg(F.sum("visits")).first()[0] or 0
    if sent and count > sent and (count * width > SENT_NUMBERS or count * (SENDING + n / len(points)) > sent * SENDING + pairs):
        return close(best(met(left.select("*", every), held.drop("cell").select("*", every), wide)))
    return close(best(found.drop("slot").unionByName(met(cut_lineage(left.mapInPandas(visits(False), visit)), held, block))))


def standardise(df: DataFrame, by: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """Fill by the group's exact median and divide by its population sd (0 becomes 1)."""
    out = df
    for c in covariates:
        filled = attach(out, exact_quantiles(df, by, c, {"__m": 0.5}), by, "left" if by else "inner")
        out = filled.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col("__m"))).drop("__m")
    sds = out.groupBy(*by).agg(*[F.stddev_pop(c).alias(f"__s_{c}") for c in covariates])
    scaled = {c: F.col(c) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(F.lit(1.0)) for c in covariates}
    return attach(out, sds, by).withColumns(scaled).drop(*[f"__s_{c}" for c in covariates])


def matched_controls(
    units: DataFrame, strata: Sequence[str], unit: str, is_case: str, covariates: Sequence[str], k: int = 5, caliper: float = 3.0
) -> DataFrame:
    """k nearest non-case units per case inside its stratum.

    A case is dropped when its k-th control is beyond the caliper or when its
    stratum has fewer than k controls.
    """
    scaled = standardise(units, strata, covariates)
    found = blocked_knn(scaled.filter(is_case), scaled.filter(~F.col(is_case)), strata, unit, unit, covariates, k, within=caliper)
    stats = found.groupBy(*strata, "query").agg(F.count(F.lit(1)).alias("c"), F.max("distance").alias("d"))
    kept = stats.filter((F.col("c") == k) & (F.col("d") <= caliper)).select(*strata, "query")
    return found.join(kept, [*strata, "query"]).select(
        *strata, F.col("query").alias("case_unit"), F.col("candidate").alias("control_unit"), "slot", "distance")


def nearest_match(candidates: DataFrame, exemplar: DataFrame, columns: Sequence[str], log_columns: Sequence[str], key: str, k: int = 1) -> DataFrame:
    """Rank candidates by standardised distance to one exemplar row."""
    value = lambda c: F.log1p(F.col(c).cast("double")) if c in log_columns else F.col(c).cast("double")
    own = exemplar.agg(*[F.max(value(c)).alias(f"__e_{c}") for c in columns])
    sds = candidates.agg(*[F.stddev_pop(value(c)).alias(f"__s_{c}") for c in columns])
    joined = attach_scalar(attach_scalar(candidates, own), sds)
    terms = [F.pow((value(c) - F.col(f"__e_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0), F.lit(2)) for c in columns]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return joined.withColumn("match_distance", F.sqrt(total)).select(*candidates.columns, "match_distance").orderBy("match_distance", key).limit(k)


def matched_slot_null(matched: DataFrame, by: Sequence[str], set_id: str, slot: str, value: str, count: int, seed: int) -> DataFrame:
    """Excess of a random pseudo-case over the rest of its set, per replicate.

    ``matched`` has one row per member (the case is slot 0). Each set reduces to
    a short array, so replicates expand sets, not members.
    """
    sets = matched.groupBy(*by, set_id).agg(F.array_sort(F.collect_list(F.struct(slot, value))).alias("m"))
    drawn = sets.select(*by, set_id, F.transform("m", lambda x: x[value].cast("double")).alias("m"), F.explode(replicates(count)).alias("replicate"))
    pick = draw(F.size("m"), F.lit(seed), F.col("replicate"), F.col(set_id))
    total = F.aggregate("m", F.lit(0.0), lambda a, x: a + x)
    drawn = drawn.withColumn("__p", F.element_at("m", (pick + 1).cast("int"))).withColumn("__t", total)
    excess = F.col("__p") - (F.col("__t") - F.col("__p")) / (F.size("m") - 1)
    return drawn.groupBy(*by, "replicate").agg(F.avg(excess).alias("excess"), F.count(F.lit(1)).alias("sets"))


def matched_excess(matched: DataFrame, by: Sequence[str], set_id: str, slot: str, value: str) -> DataFrame:
    """Observed mean of case minus mean of its controls."""
    v = F.col(value).cast("double")
    per = matched.groupBy(*by, set_id).agg(
        (F.max(F.when(F.col(slot) == 0, v)) - F.avg(F.when(F.col(slot) > 0, v))).alias("x"))
    return per.groupBy(*by).agg(F.avg("x").alias("excess"), F.count(F.lit(1)).alias("sets"))
