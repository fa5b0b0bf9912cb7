"""Helpers shared by the corpus operators: written tables, folds, word arrays, components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewise.session import discard, release, scratch_path, written  # noqa: F401

CHUNK_BYTES = 1 << 20  # texts handled by one round of array arithmetic
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ---- tables -------------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MOVING = ("Join", "Aggregate", "Sort", "Repartition", "Window", "Limit", "Sample", "LogicalRDD", "MapIn", "Generate")


def numbered(df: DataFrame, *columns: str, name: str = "_row") -> DataFrame:
    """``columns`` of ``df`` and a row number that each later scan repeats.

    Numbers follow file splits and positions, so a task that runs again and a
    second read give the same ones. Anything but a plain scan is written first.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(word in plan for word in _MOVING):
        df = written(df.select(*dict.fromkeys(columns)), "rows")
    return df.select(F.monotonically_increasing_id().alias(name), *columns)


# ---- folds --------------------------------------------------------------------------------

def fold(id_column: str | Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id counts as empty text."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def fold_of(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


# ---- Arrow --------------------------------------------------------------------------------

def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker holds the values and results of a piece only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` units; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


# ---- words --------------------------------------------------------------------------------

def lower_ascii(text: bytes) -> bytes:
    return text.lower()  # bytes.lower changes A-Z only


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each input bit over the 64-bit result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values(seed: int) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    values[_SPACE] = 0
    return values


_VALUES = _byte_values(42)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 64)
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, dtype=np.uint64))])
    return _POWERS


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts as arrays.

    ``start``/``end`` are byte places in ``buffer``, ``text`` the number of the
    text, ``hash`` a 64-bit value of the word's bytes.
    """

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.buffer, dtype=np.uint8)
        space = _SPACE[raw]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.text = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))  # first word of each text
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        gap = np.diff(np.append(self.start, len(raw)))
        place = np.arange(self.start[0], len(raw)) - np.repeat(self.start, gap)
        place[space[self.start[0]:]] = 0
        powers = _powers(int((self.end - self.start).max()))
        values = _VALUES[raw[self.start[0]:]] * powers[place]
        self.hash = mixed(np.add.reduceat(values, self.start - self.start[0]))

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k`` consecutive words, and whether they lie in one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * _STEP + self.hash[j:j + n]
        return mixed(h), self.text[:n] == self.text[k - 1:]


# ---- connected components -----------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node.

    Alternating large-star and small-star rounds: each round is one minimum per
    node and one equality join, written to the shared folder, until no edge
    changes. Stars keep the number of edges from growing, and a node of many
    edges is split by the join, never gathered.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    spark = edges.sparkSession
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        e = written(stars(stars(e, True), False), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    release(spark)
    labelled = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return labelled.select(F.col("u").alias("node"), "component").union(roots)
