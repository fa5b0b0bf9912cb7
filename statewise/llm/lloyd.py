"""Vector codes: one small codebook for each part of the vectors, refined by Lloyd rounds.

Members (a vector's part, with its row number) are resident: a partition holds the
blocks of its owners, and an owner is (position, entry, salt). A round sums its
resident members where they are, which gives the new codebooks, assigns them
again where they are, and sends only the parts whose new owner lives elsewhere through
the shuffle; what stays is united with what arrives, partition by partition. An entry
that attracts most of the parts is many owners, one for each salt, so no task grows
with it.

Only codebooks (entries x length integers) and their sums reach the driver. Members
are kept between rounds in memory or on disk and checkpointed in the shared folder every
``CHECKPOINT_EVERY`` rounds; a lost executor's part is made again from the shuffles
since then. Row numbers are written with the members, once, so that later jobs
agree on them.

Defined cases: vectors null or with null or non-finite components are left out, and so
are those not of the commonest length (of equally common ones, the longest); a length
that the number of parts does not divide is cut at floor(part x length / parts); null ids
come last among the first entries, equal ids are ordered by vector; fewer rows
than entries give fewer entries; repeated rows are rows of their own; values too large
for exact floating sums are handled as Python integers, and an error beyond a long is
null; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.llm.common import written
from statewise.session import shared_folder

OWNER_PARTS = 1 << 19  # parts of a partition, and of an owner, on average at most
BLOCK_PARTS = 1 << 15  # parts assigned at once
CHECKPOINT_EVERY = 2
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


# ---- vectors ------------------------------------------------------------------------------

def members_of(df: DataFrame, id: str, vector: str, label: str) -> tuple[DataFrame, int, int, float]:
    """Kept rows (_row, _id, _v, _label) as a written table; how many, how long, the largest magnitude."""
    v = F.col("_v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = df.select(df[id].alias("_id"), F.transform(df[vector], lambda x: x.cast("double")).alias("_v"), df[label].alias("_label"))
    kept = kept.where(v.isNotNull() & ~F.exists(v, bad))
    lengths = kept.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform(v, F.abs))).alias("top"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    d = most.d if most else 0
    rows = written(kept.where(F.size(v) == d).select(F.monotonically_increasing_id().alias("_row"), "_id", "_v", "_label"), "members")
    return rows, (most.n if most else 0), d, (most.top or 0.0) if most else 0.0


def integers(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x), as Python integers if ``wide``."""
    if not wide:
        return np.floor(x * scale).astype(np.int32)
    whole = lambda y: math.floor(scale * y) if abs(y) < _EXACT else int(y) * scale
    return np.array([whole(float(y)) for y in x.flat], dtype=object).reshape(x.shape)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, the lowest of equally near ones, and its squared distance."""
    if parts.dtype == object:
        far = np.stack([((parts - e) ** 2).sum(axis=1) if parts.shape[1] else np.zeros(len(parts), object) for e in book], axis=1)
    else:
        x, c = parts.astype(float), book.astype(float)  # every sum here is below 2**53
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    best = far.argmin(axis=1).astype(np.int64)
    return best, far[np.arange(len(best)), best]


# ---- owners -------------------------------------------------------------------------------

class Owners:
    """Numbers of owners (position, entry, salt) and the partitions they live in."""

    def __init__(self, parts: int, entries: int, salts: int, partitions: int):
        self.parts, self.entries, self.salts, self.partitions = parts, entries, salts, partitions

    def of(self, position: int, entry: int, salt: int) -> int:
        return (position * self.entries + entry) * self.salts + salt

    def split(self, owner: int) -> tuple[int, int, int]:
        rest, salt = divmod(owner, self.salts)
        return *divmod(rest, self.entries), salt

    def salts_of(self, rows: np.ndarray) -> np.ndarray:
        """Rows that were written together share a salt, so blocks stay large."""
        return ((rows >> 33) * 31 + ((rows & ((1 << 33) - 1)) >> 14)) % self.salts

    def blocks(self, position: int, entry: np.ndarray, salt: np.ndarray, rows: np.ndarray, parts: np.ndarray) -> Iterator[tuple]:
        """(owner, (rows, parts)) for each owner that occurs."""
        owner = (position * self.entries + entry) * self.salts + salt
        order = np.argsort(owner, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            if len(group):
                yield int(owner[group[0]]), (rows[group], parts[group])


def home(owner: int) -> int:
    return ((owner * 0x9E3779B1) & 0xFFFFFFFF) >> 5


def by_owner(items: Iterator[tuple]) -> Iterator[tuple]:
    """The same members with an owner's small blocks put together."""
    held: dict[int, list] = {}
    sizes: dict[int, int] = {}

    def together(owner):
        blocks = held.pop(owner)
        del sizes[owner]
        return owner, tuple(np.concatenate(x) for x in zip(*blocks))

    for owner, block in items:
        held.setdefault(owner, []).append(block)
        sizes[owner] = sizes.get(owner, 0) + len(block[0])
        if sizes[owner] >= BLOCK_PARTS:
            yield together(owner)
    for owner in list(held):
        yield together(owner)


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    return [(j * length // parts, (j + 1) * length // parts) for j in range(parts)]


def first_blocks(rows: DataFrame, length: int, scale: int, wide: bool, books: list, owners: Owners) -> RDD:
    """(owner, (rows, parts)) of all members after their first assignment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            number = b.column(0).to_numpy()
            x = integers(np.asarray(b.column(1).flatten(), dtype=float).reshape(len(b), length), scale, wide)
            salt = owners.salts_of(number)
            out = []
            for j, (lo, hi) in enumerate(bounds(length, owners.parts)):
                out += owners.blocks(j, nearest(x[:, lo:hi], books[j])[0], salt, number, x[:, lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([pickle.dumps(m) for _, m in out], pa.binary())], ["owner", "block"])

    return rows.select("_row", "_v").mapInArrow(run, "owner long, block binary").rdd.map(lambda r: (r[0], pickle.loads(r[1])))


# ---- rounds -------------------------------------------------------------------------------

def member_sums(residents: RDD, owners: Owners) -> list[tuple]:
    """((position, entry), (count, sums)) of all resident members: at most a codebook's size."""
    def partial(items):
        total: dict[tuple, list] = {}
        for owner, (rows, parts) in items:
            t = total.setdefault(owners.split(owner)[:2], [0, 0])
            t[0] += len(rows)
            t[1] = t[1] + (parts.sum(axis=0) if parts.dtype == object else parts.sum(axis=0, dtype=np.int64).astype(object))
        return [(k, tuple(v)) for k, v in total.items()]

    few = min(owners.partitions, 8)
    return residents.mapPartitions(partial).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), few).collect()


def updated(books: list, sums: list[tuple]) -> list:
    """Entries replaced by the floor of their members' mean; unused ones stay."""
    out = [b.copy() for b in books]
    for (position, entry), (n, total) in sums:
        out[position][entry] = total // n
    return out


def migrated(residents: RDD, books: list, owners: Owners, keep: list) -> RDD:
    """Members assigned anew; only those whose owner lives in another partition are shuffled."""
    def run(part, items):
        for owner, (rows, parts) in by_owner(items):
            position, _, salt = owners.split(owner)
            for new, block in owners.blocks(position, nearest(parts, books[position])[0], np.full(len(rows), salt), rows, parts):
                yield home(new) % owners.partitions == part, (new, block)

    moved = residents.mapPartitionsWithIndex(run, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    keep.append(moved)
    if len(keep) % CHECKPOINT_EVERY == 0:
        moved.checkpoint()
    stay = moved.mapPartitions(lambda it: (x for here, x in it if here), preservesPartitioning=True)
    leave = moved.mapPartitions(lambda it: (x for here, x in it if not here)).partitionBy(owners.partitions, home)
    return stay.union(leave)


def coded(residents: RDD, books: list, owners: Owners, spark) -> DataFrame:
    """(_row, code, error): entries by position as two hex digits each, squared distances summed."""
    def assign(items):
        for owner, (rows, parts) in by_owner(items):
            position = owners.split(owner)[0]
            entry, far = nearest(parts, books[position])
            yield position, pickle.dumps((rows, entry, [int(x) for x in far]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for position, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, entry, far = pickle.loads(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array([position] * len(rows), pa.int32()), pa.array(entry.astype(np.int32)), pa.array([x if x <= _LONG else None for x in far], pa.int64())],
                    ["_row", "position", "entry", "far"])

    flat = spark.createDataFrame(residents.mapPartitions(assign), "position int, block binary", verifySchema=False).mapInArrow(spread, "_row long, position int, entry int, far long")
    listed = F.array_sort(F.collect_list(F.struct("position", F.lower(F.lpad(F.hex("entry"), 2, "0")).alias("digits"))))
    return flat.groupBy("_row").agg(
        F.array_join(F.transform(listed, lambda s: s["digits"]), "").alias("code"),
        F.when(F.count("far") == F.count("*"), F.try_sum("far")).alias("error"))


def digest(books: list) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flat).encode()).hexdigest()


def vector_codes(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list]:
    """Codes of all usable vectors, and the final codebooks (an entries x width array for each part).

    Columns: the id, the label, code, error, label_error (error summed over equal
    labels, nulls together), codebooks_sha256.
    """
    spark = df.sparkSession
    rows, n, length, top = members_of(df, id, vector, label)
    head = rows.orderBy(F.asc_nulls_last("_id"), "_v", "_row").limit(entries).collect()
    width = -(-length // parts)
    wide = scale * top + 1 >= math.sqrt(_EXACT / (4 * max(width, 1)))
    start = integers(np.array([r._v for r in head], dtype=float).reshape(len(head), length), scale, wide).astype(object)
    books = [start[:, lo:hi] for lo, hi in bounds(length, parts)]
    salts = max(1, -(-n // OWNER_PARTS))
    wanted = max(spark.sparkContext.defaultParallelism, -(-n * parts // OWNER_PARTS))
    owners = Owners(parts, max(len(head), 1), salts, min(wanted, parts * max(len(head), 1) * salts))
    if n == 0:
        codes = rows.select("_row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(shared_folder(spark))
        keep: list[RDD] = []
        residents = first_blocks(rows, length, scale, wide, books, owners).partitionBy(owners.partitions, home)
        for done in range(1, rounds + 1):
            books = updated(books, member_sums(residents, owners))
            for old in keep[:-1]:
                old.unpersist()
            if done < rounds:
                residents = migrated(residents, books, owners, keep)
        codes = written(coded(residents, books, owners, spark), "codes")
        for old in keep:
            old.unpersist()
    out = rows.select("_row", "_id", "_label").join(codes, "_row")
    labels = out.groupBy(F.col("_label").alias("_l")).agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    out = out.join(labels, F.col("_label").eqNullSafe(F.col("_l")))
    named = [F.col("_id").alias(id), F.col("_label").alias(label), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")]
    return out.select(*named), books
