"""Matrices as distributed square blocks: moments, products, ridge solves, spectra.

A matrix is an RDD of ``((row block, column block), cells)`` with at most
``SIDE`` x ``SIDE`` cells, dense or as coordinates; a tall one (few columns) is an
RDD of ``(row block, cells)``. Products, sums and solves are joins and reductions by
block key, so no task and no driver step holds a matrix, and one method serves every size.
What reaches the driver are projections of a Krylov block (a few hundred squared
numbers) and one scalar per output column of a solve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewise.session import prepare_checkpoints

SIDE = 256
GROUP = 4  # blocks on a side of a product's unit of work
MOMENT_BYTES = 64 << 20  # partial moments that one task adds up before it passes them on
CHUNK_CELLS = 1 << 22  # dense cells made from sparse rows at once
STRIPE_BLOCKS = 512  # blocks that meet one block of a tall matrix in a task
CHECKPOINT_EVERY = 8


class Blocks(NamedTuple):
    rdd: RDD
    rows: int
    cols: int


def count(n: int) -> int:
    return -(-n // SIDE)


def tasks(blocks: int) -> int:
    return max(1, -(-blocks // (GROUP * GROUP)))


def dense(x) -> np.ndarray:
    """Cells of a block; a mostly empty one is a tuple (i, j, w, shape)."""
    if not isinstance(x, tuple):
        return x
    i, j, w, shape = x
    out = np.zeros(shape)
    np.add.at(out, (i, j), w)
    return out


def kept(rdd: RDD) -> RDD:
    return rdd.persist(StorageLevel.MEMORY_AND_DISK)


def applied(x, y: np.ndarray) -> np.ndarray:
    """x @ y of a block and dense cells."""
    if not isinstance(x, tuple):
        return x @ y
    i, j, w, shape = x
    out = np.zeros((shape[0], y.shape[1]))
    np.add.at(out, i, w[:, None] * y[j])
    return out


# ---- from and to rows ---------------------------------------------------------------------

def from_triplets(cells: DataFrame, rows: int, cols: int) -> Blocks:
    """Blocks of (i, j, value) rows; repeated cells add up, so a block gathers SIDE squared entries at most."""
    once = cells.groupBy("i", "j").agg(F.sum("value").alias("value"))
    at = lambda c: F.floor(F.col(c) / SIDE).cast("int")
    packed = once.groupBy(at("i").alias("r"), at("j").alias("c")).agg(
        F.collect_list(F.struct((F.col("i") % SIDE).cast("int").alias("i"), (F.col("j") % SIDE).cast("int").alias("j"), F.col("value").cast("double").alias("w"))).alias("p"))

    def block(row):
        r, c, p = row
        shape = (min(SIDE, rows - r * SIDE), min(SIDE, cols - c * SIDE))
        x = np.array([e[0] for e in p], np.int32), np.array([e[1] for e in p], np.int32), np.array([e[2] for e in p]), shape
        return (r, c), (dense(x) if 8 * len(p) > shape[0] * shape[1] else x)

    return Blocks(packed.rdd.map(block), rows, cols)


def to_table(m: Blocks, spark: SparkSession) -> DataFrame:
    """(r, c, width, cells): a row for each block, cells in row order."""
    def row(kv):
        (r, c), x = kv
        x = np.ascontiguousarray(dense(x), dtype=float)
        return r, c, x.shape[1], bytearray(x.tobytes())

    return spark.createDataFrame(m.rdd.map(row), "r int, c int, width int, cells binary", verifySchema=False)


def to_triplets(m: Blocks, spark: SparkSession, zeros: bool = False) -> DataFrame:
    """(i, j, value), without the zeros unless asked for."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, c, width, cells in zip(*(x.to_pylist() for x in b.columns)):
                x = np.frombuffer(cells).reshape(-1, width)
                i, j = np.indices(x.shape) if zeros else np.nonzero(x)
                v = x.ravel() if zeros else x[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel() + r * SIDE, pa.int64()), pa.array(j.ravel() + c * SIDE, pa.int64()), pa.array(v)], ["i", "j", "value"])

    return to_table(m, spark).mapInArrow(spread, "i long, j long, value double")


# ---- sums over many partials --------------------------------------------------------------

def summed(partials: RDD, parts: int) -> RDD:
    """Partials added by key; beyond 64 tasks in two levels, so no key hears from every task at once."""
    add = lambda a, b: a + b
    many = partials.getNumPartitions()
    if many > 64:
        fan = int(many**0.5)
        salted = partials.mapPartitionsWithIndex(lambda p, it: (((k, p % fan), v) for k, v in it))
        partials = salted.reduceByKey(add, min(many, parts * fan)).map(lambda kv: (kv[0][0], kv[1]))
    return partials.reduceByKey(add, parts)


# ---- moments ------------------------------------------------------------------------------

def moments(rows: DataFrame, left: tuple[str, str], right: tuple[str, str], p: int, q: int) -> tuple[Blocks, DataFrame, DataFrame]:
    """X'Y of sparse rows, and the sums behind it.

    ``left`` and ``right`` name the index and value array columns of each row. The
    second and third results are (b, stats) for each block of columns: sums, sums of
    squares and the number of rows, 3 x width doubles. A task adds up a slab of X'Y
    that fits ``MOMENT_BYTES``; a panel too wide for one slab sends its rows to each.
    """
    spark = rows.sparkSession
    slab = max(SIDE, MOMENT_BYTES // (8 * max(q, 1)) // SIDE * SIDE)
    slabs = max(1, -(-p // slab))
    step = max(1, CHUNK_CELLS // max(p if slabs == 1 else slab, q, 1))
    data = rows.select(F.lit(0).alias("slab"), *[F.col(c) for c in (*left, *right)])
    if slabs > 1:
        data = data.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))).withColumn("_part", F.spark_partition_id())
        data = data.repartition("slab", "_part").sortWithinPartitions("slab").drop("_part")

    def filled(idx, val, n, width, first):
        out = np.zeros((n, width))
        at = np.repeat(np.arange(n), np.diff(idx.offsets.to_numpy()))
        j, v = idx.flatten().to_numpy() - first, val.flatten().to_numpy(zero_copy_only=False)
        ok = (j >= 0) & (j < width)
        np.add.at(out, (at[ok], j[ok]), v[ok])
        return out

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        now = None

        def flush():
            if now is None:
                return
            out = []
            first = now * slab
            g = held["g"]
            for a in range(0, g.shape[0], SIDE):
                out += [(0, (first + a) // SIDE, b // SIDE, g[a:a + SIDE, b:b + SIDE]) for b in range(0, g.shape[1], SIDE)]
                out.append((1, (first + a) // SIDE, 0, held["x"][:, a:a + SIDE]))
            if now == 0:
                out += [(2, b // SIDE, 0, held["y"][:, b:b + SIDE]) for b in range(0, q, SIDE)]
            for kind, r, c, cells in out:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([r], pa.int32()), pa.array([c], pa.int32()), pa.array([cells.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(cells).tobytes()], pa.binary())], ["kind", "r", "c", "width", "cells"])

        for batch in batches:
            marks = batch.column(0).to_numpy()
            for s in np.unique(marks):
                if s != now:
                    yield from flush()
                    now = int(s)
                    width = min(slab, p - now * slab) if slabs > 1 else p
                    held = {"g": np.zeros((width, q)), "x": np.zeros((3, width)), "y": np.zeros((3, q))}
                mine = batch.filter(pa.array(marks == s)) if len(np.unique(marks)) > 1 else batch
                for at in range(0, len(mine), step):
                    piece = pa.RecordBatch.from_arrays([pa.concat_arrays([x.slice(at, step)]) for x in mine.columns], names=mine.schema.names)
                    n = len(piece)
                    x = filled(piece.column(1), piece.column(2), n, held["g"].shape[0], now * slab)
                    y = filled(piece.column(3), piece.column(4), n, q, 0)
                    held["g"] += x.T @ y
                    held["x"] += [x.sum(axis=0), (x * x).sum(axis=0), np.full(x.shape[1], n)]
                    held["y"] += [y.sum(axis=0), (y * y).sum(axis=0), np.full(q, n)]
        yield from flush()

    parts = data.mapInArrow(partial, "kind int, r int, c int, width int, cells binary").rdd
    keyed = parts.map(lambda x: ((x[0], x[1], x[2]), np.frombuffer(x[4]).reshape(-1, x[3])))
    total = kept(summed(keyed, tasks(count(p) * count(q))))
    table = lambda kind: spark.createDataFrame(
        total.filter(lambda kv: kv[0][0] == kind).map(lambda kv: (kv[0][1], bytearray(np.ascontiguousarray(kv[1]).tobytes()))), "b int, stats binary", verifySchema=False)
    return Blocks(total.filter(lambda kv: kv[0][0] == 0).map(lambda kv: (kv[0][1:], kv[1])), p, q), table(1), table(2)


def paired_moments(rows: DataFrame, left: tuple[str, str], right: tuple[str, str], p: int) -> tuple[Blocks, Blocks, DataFrame, DataFrame]:
    """X'X and X'Y in one pass, and the sums behind X and Y."""
    blocks = count(p)
    both = rows.select(
        F.col(left[0]).alias("xi"), F.col(left[1]).alias("xx"),
        F.concat(left[0], F.transform(right[0], lambda i: i + blocks * SIDE)).alias("yi"), F.concat(left[1], right[1]).alias("yx"))
    m, xs, ys = moments(both, ("xi", "xx"), ("yi", "yx"), p, blocks * SIDE + p)
    trim = lambda kv: (kv[0], kv[1][:, :p - kv[0][1] * SIDE])  # noqa: E731  the last block of X'X is as wide as a whole one here
    xx = Blocks(m.rdd.filter(lambda kv: kv[0][1] < blocks).map(trim), p, p)
    xy = Blocks(m.rdd.filter(lambda kv: kv[0][1] >= blocks).map(lambda kv: ((kv[0][0], kv[0][1] - blocks), kv[1])), p, p)
    return xx, xy, xs, ys.filter(F.col("b") >= blocks).select((F.col("b") - blocks).alias("b"), "stats")


def with_stats(m: Blocks, left: DataFrame, right: DataFrame, spark: SparkSession) -> DataFrame:
    """(r, c, width, cells, ls, rs): each block with the sums of its rows and columns."""
    t = to_table(m, spark)
    return t.join(left.select(F.col("b").alias("r"), F.col("stats").alias("ls")), "r").join(right.select(F.col("b").alias("c"), F.col("stats").alias("rs")), "c").select("r", "c", "width", "cells", "ls", "rs")


def blockwise(t: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], out: str) -> DataFrame:
    """(r, c, i, ``out``): rows of f(cells, row sums, column sums) of each block, i within the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, c, width, cells, ls, rs in zip(*(x.to_pylist() for x in b.columns)):
                y = f(np.frombuffer(cells).reshape(-1, width), np.frombuffer(ls).reshape(3, -1), np.frombuffer(rs).reshape(3, -1))
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([r] * n, pa.int32()), pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(y), pa.list_(pa.float64()))], ["r", "c", "i", out])

    return t.mapInArrow(run, f"r int, c int, i int, {out} array<double>")


def centred(m: Blocks, left: DataFrame, right: DataFrame, spark: SparkSession) -> Blocks:
    """X'Y with the means of X and Y taken out."""
    t = with_stats(m, left, right, spark)

    def block(x):
        g = np.frombuffer(x[3]).reshape(-1, x[2])
        ls, rs = np.frombuffer(x[4]).reshape(3, -1), np.frombuffer(x[5]).reshape(3, -1)
        return (x[0], x[1]), g - np.outer(ls[0], rs[0] / np.maximum(rs[2], 1))

    return Blocks(t.rdd.map(block), m.rows, m.cols)


# ---- products -----------------------------------------------------------------------------

def transposed(m: Blocks) -> Blocks:
    def turn(kv):
        (r, c), x = kv
        return (c, r), ((x[1], x[0], x[2], x[3][::-1]) if isinstance(x, tuple) else x.T)

    return Blocks(m.rdd.map(turn), m.cols, m.rows)


def multiply(a: Blocks, b: Blocks) -> Blocks:
    """A B: groups of GROUP x GROUP blocks of each meet, products add up by block."""
    over_cols, over_rows = -(-count(b.cols) // GROUP), -(-count(a.rows) // GROUP)
    parts = tasks(count(a.rows) * count(b.cols))
    left = a.rdd.flatMap(lambda kv: (((kv[0][0] // GROUP, kv[0][1] // GROUP, o), kv) for o in range(over_cols)))
    right = b.rdd.flatMap(lambda kv: (((r, kv[0][0] // GROUP, kv[0][1] // GROUP), kv) for r in range(over_rows)))

    def products(group):
        xs, ys = group[1]
        by_row: dict[int, list] = {}
        for (c, o), y in ys:
            by_row.setdefault(c, []).append((o, dense(y)))
        total: dict[tuple, np.ndarray] = {}
        for (r, c), x in xs:
            for o, y in by_row.get(c, ()):
                z = applied(x, y)
                total[r, o] = total[r, o] + z if (r, o) in total else z
        return total.items()

    met = left.cogroup(right, max(parts, tasks(count(a.cols) * (count(a.rows) + count(b.cols)))))
    return Blocks(met.flatMap(products).reduceByKey(lambda x, y: x + y, parts), a.rows, b.cols)


def scaled(m: Blocks, factor: float) -> Blocks:
    def times(kv):
        k, x = kv
        return k, ((*x[:2], x[2] * factor, x[3]) if isinstance(x, tuple) else x * factor)

    return Blocks(m.rdd.map(times), m.rows, m.cols)


# ---- ridge --------------------------------------------------------------------------------

def column_sums(a: Blocks, b: Blocks, n: int, *fs: Callable) -> list[np.ndarray]:
    """For each f the sums over rows of f(A, B), one number for each column."""
    def partial(kv):
        x, y = kv[1]
        return kv[0][1], np.stack([f(x, y).sum(axis=0) for f in fs])

    joined = a.rdd.join(b.rdd, tasks(count(a.rows) * count(a.cols)))
    found = joined.map(partial).reduceByKey(lambda x, y: x + y, tasks(count(a.cols))).collect()
    out = np.zeros((len(fs), n))
    for c, v in found:
        out[:, c * SIDE:c * SIDE + v.shape[1]] = v
    return list(out)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x * y


def square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x * x


def ridge_solve(gram: Blocks, right: Blocks, alpha: float, tol: float = 1e-11, limit: int = 500) -> tuple[Blocks, np.ndarray, int]:
    """(G + alpha I) B = R by conjugate gradients on all columns at once.

    Diagonal blocks, inverted where they are, are the preconditioner; a column stops
    when its residual is ``tol`` of its right side. Also returns the true relative
    residual of each column, computed from the result, and the rounds taken.
    """
    sc = gram.rdd.context
    prepare_checkpoints(sc)
    n, rows = right.cols, gram.rows
    eye = lambda k: alpha * np.eye(min(SIDE, rows - k * SIDE))
    g = Blocks(kept(gram.rdd.map(lambda kv: (kv[0], dense(kv[1]) + eye(kv[0][0]) if kv[0][0] == kv[0][1] else dense(kv[1])))), gram.rows, gram.cols)
    inverse = Blocks(kept(g.rdd.filter(lambda kv: kv[0][0] == kv[0][1]).map(lambda kv: (kv[0], np.linalg.inv(kv[1])))), gram.rows, gram.cols)
    part = lambda v: (lambda c: v[c * SIDE:(c + 1) * SIDE])

    def axpy(a: Blocks, b: Blocks, v: np.ndarray) -> Blocks:
        cut = part(v)
        return Blocks(a.rdd.join(b.rdd, tasks(count(a.rows) * count(a.cols))).map(lambda kv: (kv[0], kv[1][0] + kv[1][1] * cut(kv[0][1]))), a.rows, a.cols)

    hold = lambda m: Blocks(kept(m.rdd), m.rows, m.cols)
    b = hold(right)
    x, r = Blocks(b.rdd.mapValues(lambda v: v * 0.0), right.rows, n), b
    d = hold(multiply(inverse, r))
    norm, rho = column_sums(r, d, n, square, product)
    norm = np.sqrt(norm)
    goal = np.where(norm > 0, norm, 1.0)
    rounds, old = 0, []
    while rounds < limit and norm.any():
        rounds += 1
        q = hold(multiply(g, d))
        (curve,) = column_sums(d, q, n, product)
        a = np.divide(rho, curve, out=np.zeros(n), where=curve > 0)
        x, r = hold(axpy(x, d, a)), hold(axpy(r, q, -a))
        if rounds % CHECKPOINT_EVERY == 0:
            x.rdd.checkpoint()
            r.rdd.checkpoint()
            x.rdd.count()
            for m in old:
                m.rdd.unpersist()
            old = []
        z = hold(multiply(inverse, r))
        left, now = column_sums(r, z, n, square, product)
        left = np.sqrt(left)
        if (left <= tol * goal).all():
            break
        beta = np.where(left > tol * goal, np.divide(now, rho, out=np.zeros(n), where=rho > 0), 0.0)
        old, d, rho = [*old, q, d, z], hold(axpy(z, d, beta)), now
        if rounds % CHECKPOINT_EVERY == 0:
            d.rdd.checkpoint()
    (off,) = column_sums(multiply(g, x), b, n, lambda u, v: (u - v) ** 2)
    return x, np.sqrt(off) / goal, rounds


# ---- spectra ------------------------------------------------------------------------------

class Tall(NamedTuple):
    """Few columns over many rows: (row block, cells)."""

    rdd: RDD
    rows: int


def stripes(m: Blocks) -> tuple[RDD, int]:
    """Blocks keyed by (column block, salt) for products with tall matrices, kept in place between them."""
    salts = max(1, -(-count(m.rows) // STRIPE_BLOCKS))
    keyed = m.rdd.map(lambda kv: ((kv[0][1], kv[0][0] % salts), (kv[0][0], kv[1])))
    return kept(keyed.partitionBy(tasks(count(m.rows) * count(m.cols)))), salts


def times(striped: tuple[RDD, int], v: Tall) -> Tall:
    """W V; W's stripes stay where they are and V's blocks come to them."""
    w, salts = striped
    parts = w.getNumPartitions()
    copies = v.rdd.flatMap(lambda kv: (((kv[0], s), kv[1]) for s in range(salts)))

    def products(group):
        _, (blocks, ys) = group
        for y in ys:
            for r, x in blocks:
                yield r, applied(x, y)

    return Tall(w.cogroup(copies, parts).flatMap(products).reduceByKey(lambda a, b: a + b, tasks(count(v.rows))), v.rows)


def meet(a: Tall, b: Tall, f: Callable) -> Tall:
    """f of the blocks of both; an absent one is None."""
    def both(kv):
        k, (xs, ys) = kv
        return k, f(next(iter(xs), None), next(iter(ys), None))

    return Tall(a.rdd.cogroup(b.rdd, tasks(count(a.rows))).map(both), a.rows)


def crossed(pairs: Tall, f: Callable) -> np.ndarray | tuple:
    """Sum of f(cells) over blocks: a few columns squared."""
    def partial(it):
        total = None
        for _, x in it:
            y = f(x)
            total = y if total is None else tuple(a + b for a, b in zip(total, y))
        return [] if total is None else [total]

    return pairs.rdd.mapPartitions(partial).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b)))


def orthonormal(gram: np.ndarray, scale: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """T with (Y T)'(Y T) = I for Y'Y = gram, and R with Y = Y T R; dependent columns and those beyond ``most`` are dropped."""
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    good = (value > max(scale * 1e-24, value[-1] * 1e-14, 1e-300)) & (np.arange(len(value)) >= len(value) - most)
    root = np.sqrt(value[good])
    return vector[:, good] / root, (vector[:, good] * root).T


class Extremes(NamedTuple):
    values: np.ndarray  # Ritz values, the wanted one first
    residuals: np.ndarray  # of the wanted ones, relative to each
    converged: bool
    products: int


def krylov(apply: Callable[[Tall], Tall], n: int, spark: SparkSession, ends: str = "modulus", block: int = 32, width: int = 256, tol: float = 1e-9, restarts: int = 40) -> Extremes:
    """Outermost eigenvalues of an operator by block Arnoldi with restarts.

    ``ends`` is "modulus" (the largest magnitude) or "both" (largest and smallest of a
    symmetric operator). A basis of at most ``width`` vectors is built in blocks; a
    wanted Ritz pair is done when its residual is ``tol`` of its value, or when the
    basis is the whole space. A restart keeps the space of the leading pairs.
    """
    sc = spark.sparkContext
    prepare_checkpoints(sc)
    b = min(block, n)
    parts = tasks(count(n))

    def start(r):
        rows = min(SIDE, n - r * SIDE)
        return r, (np.eye(n)[r * SIDE:r * SIDE + rows] if n <= block else np.random.default_rng([7, r]).standard_normal((rows, b)))

    alive: list[RDD] = []

    def hold(rdd: RDD) -> Tall:
        nonlocal alive
        alive.append(kept(rdd))
        return Tall(rdd, n)

    def drop(some: list[RDD]) -> None:
        for rdd in some:
            rdd.unpersist()

    v = hold(sc.parallelize(range(count(n)), parts).map(start).partitionBy(parts))
    used = 0
    best = Extremes(np.zeros(1), np.zeros(1), False, 0)

    def settle(y: Tall) -> tuple[Tall, np.ndarray]:
        """Orthonormal columns for y's, twice for good measure."""
        full = None
        for _ in range(2):
            (gram,) = crossed(y, lambda x: (x.T @ x,))
            t, r = orthonormal(gram, float(np.trace(gram)), n)
            y = hold(y.rdd.mapValues(lambda x, t=t: x @ t))
            full = r if full is None else r @ full
            if np.linalg.cond(gram) < 1e6:
                break
        return y, full

    if n > block:
        v, _ = settle(v)
    for again in range(restarts + 1):
        q, h, last, rank, whole = v, None, None, None, False
        sizes = [b]
        while True:
            y = hold(apply(v).rdd)
            used += 1
            pairs = hold(meet(q, y, lambda a, c, k=sizes[-1]: (a, c if c is not None else np.zeros((len(a), k)))).rdd)
            (s1,) = crossed(pairs, lambda x: (x[0].T @ x[1],))
            if sum(sizes) >= n and h is None:  # the first block is the whole space
                value = np.linalg.eigvals(s1)
                value = value[np.argsort(-np.abs(value)) if ends == "modulus" else np.argsort(-value.real)]
                wanted = [0] if ends == "modulus" else [0, n - 1]
                drop(alive)
                return Extremes(value[wanted], np.zeros(len(wanted)), True, used)
            once = hold(pairs.rdd.mapValues(lambda x, s=s1: (x[0], x[1] - x[0] @ s)))
            s2, gram = crossed(once, lambda x: (x[0].T @ x[1], x[1].T @ x[1]))
            column = s1 + s2
            gram = gram - s2.T @ s2
            m = sum(sizes)
            grown = np.zeros((m, m))
            if h is not None:
                grown[:h.shape[0], :h.shape[1]] = h
                grown[h.shape[0]:, h.shape[1] - last.shape[1]:h.shape[1]] = last
            grown[:, m - sizes[-1]:] = column
            h = grown
            size = float(np.sum(column * column)) + max(float(np.trace(gram)), 0.0)
            t, last = orthonormal(gram, size, n - m)
            rank = t.shape[1]
            whole = rank == 0
            value, vector = np.linalg.eig(h)
            order = np.argsort(-np.abs(value)) if ends == "modulus" else np.argsort(-value.real)
            value, vector = value[order], vector[:, order]
            tail = np.zeros((0, m)) if whole else last @ vector[m - sizes[-1]:]
            off = np.zeros(m) if whole else np.linalg.norm(tail, axis=0) / np.maximum(np.abs(value), 1e-300)
            wanted = [0] if ends == "modulus" else [0, m - 1]
            best = Extremes(value[wanted], off[wanted], bool((off[wanted] <= tol).all()), used)
            if whole or best.converged or m + rank > width:
                break
            new = hold(once.rdd.mapValues(lambda x, s=s2, t=t: (x[1] - x[0] @ s) @ t))
            new, more = settle(new)
            last = more @ last
            sizes.append(last.shape[0])
            q = hold(meet(q, new, lambda a, c: np.hstack([a, c])).rdd)
            v = new
        if whole or best.converged or again == restarts:
            drop(alive)
            return best._replace(converged=best.converged or whole)
        # the leading pairs' space, as real orthonormal columns
        lead = list(range(m)) if ends == "modulus" else [i for pair in zip(range(m), reversed(range(m))) for i in pair]
        basis = np.zeros((m, 0))
        for i in lead:
            for c in (vector[:, i].real, vector[:, i].imag):
                c = c - basis @ (basis.T @ c)
                c = c - basis @ (basis.T @ c)
                if basis.shape[1] < b and np.linalg.norm(c) > 1e-8:
                    basis = np.hstack([basis, (c / np.linalg.norm(c))[:, None]])
        old, alive = alive, []
        v = hold(q.rdd.mapValues(lambda x, u=basis: x @ u))
        v.rdd.checkpoint()
        v, _ = settle(v)
        crossed(v, lambda x: (x.T @ x,))
        drop(old)
        b = basis.shape[1]
    return best
