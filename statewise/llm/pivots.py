"""Exact top-k search by pivot-table elimination.

The greatest inner product is the smallest distance once every vector gets one
more component that brings all to the same norm. Distances of all candidates to
fixed pivots are computed once; by the triangle inequality the largest
difference of two distances to a pivot bounds a distance from below. Candidates
are evaluated in the order of their bound, and a query stops when the next bound
exceeds its k-th best distance, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewise.llm.common import written

PIVOTS = 32
PIVOT_SAMPLE = 4096  # rows, by a hash of the id, among which the pivots are chosen; only speed depends on them
BLOCK = 2048  # candidates of a block
QUERY_BLOCK = 4096  # queries that meet a block of candidates together
STEP = 64  # candidates evaluated between two looks at the bound
SLACK = 1e-6  # share by which a bound is lowered against rounding


def quantized(df: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): floor(scale * x) of vectors all of whose components are finite."""
    x = F.col(vector_column)
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    good = df.where(x.isNotNull() & F.col(id_column).isNotNull() & ~F.exists(x, bad))
    return good.select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def matrix(column: pa.Array) -> list[np.ndarray]:
    """Vectors of an Arrow list column as integer rows."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the row farthest from those before."""
    if not len(sample):
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def search_block(q: np.ndarray, dq: np.ndarray, x: np.ndarray, dx: np.ndarray, ids: np.ndarray, own: np.ndarray, top: np.ndarray, radius: float, k: int) -> None:
    """Update ``top`` (k pairs of score and id for each query) with one block of candidates.

    ``q``, ``x``: integer rows; ``dq``, ``dx``: distances to the pivots; ``own``: ids of
    the queries; ``radius``: the common squared norm.
    """
    norm = (q.astype(np.float64) ** 2).sum(1)
    for i in range(len(q)):
        bound = np.abs(dx - dq[i]).max(axis=1) if dx.shape[1] else np.zeros(len(x))
        order = np.argsort(bound, kind="stable")
        bound = bound[order] * (1 - SLACK)
        # inner product that a distance of ``bound`` allows at most
        allowed = (norm[i] + radius - bound * bound) / 2 + SLACK * (norm[i] + radius)
        for at in range(0, len(order), STEP):
            if allowed[at] < top[i, k - 1, 0]:
                break
            some = order[at:at + STEP]
            score = x[some] @ q[i]
            keep = (score >= top[i, k - 1, 0]) & (ids[some] != own[i])
            if keep.any():
                both = np.concatenate([top[i], np.stack([score[keep], ids[some][keep]], axis=1)])
                top[i] = both[np.lexsort((both[:, 1], -both[:, 0]))][:k]


NONE = -(1 << 62)


def top_k(
    df: DataFrame, k: int = 5, query_modulus: int = 50, scale: int = 256, pivots: int = PIVOTS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` greatest inner products of each query with other rows.

    Queries are rows whose id is divisible by ``query_modulus``, candidates all
    rows but those with the query's id. Components become floor(scale * x); ties go
    to the smaller id. Vectors that are null, or hold null or non-finite components,
    and rows with a null id take no part; a vector meets vectors of its own length
    only. Repeated rows are candidates each; a repeated query id is answered
    once for each of its rows, with ranks over all of them. Empty vectors score 0.
    Other columns are not read; without candidates a query has no rows.
    """
    rows = written(quantized(df, scale, id_column, vector_column), "vectors")
    facts = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)), F.count(F.when(F.col("id") % query_modulus == 0, 1))).first()
    if facts[0] is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, radius, queries = int(facts[0]), float(facts[1]), int(facts[2])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toArrow().column(0).combine_chunks()
    fitting = [v for v in matrix(sample) if len(v) == width]

    def lifted(m: np.ndarray) -> np.ndarray:
        m = m.astype(np.float64)
        return np.concatenate([m, np.sqrt(np.maximum(radius - (m * m).sum(1, keepdims=True), 0))], axis=1)

    points = choose_pivots(lifted(np.stack(fitting)), pivots)
    # ``v`` of other lengths are put apart by their length and bounded by no pivot
    def distances(m: np.ndarray, query: bool) -> np.ndarray:
        if m.shape[1] != width:
            return np.zeros((len(m), 0))
        up = np.concatenate([m.astype(np.float64), np.zeros((len(m), 1))], axis=1) if query else lifted(m)
        return np.sqrt(np.maximum(((up[:, None, :] - points[None]) ** 2).sum(2), 0)) if len(points) else np.zeros((len(m), 0))

    def blocks(size: int, query: bool):
        def pack(batches):
            held: dict[int, tuple[list, list]] = {}

            def row(length):
                ids, vectors = held.pop(length)
                m = np.array(vectors, dtype=np.int64).reshape(len(ids), length)
                d = distances(m, query)
                return pa.RecordBatch.from_arrays(
                    [pa.array([length], type=pa.int32()), pa.array([np.array(ids, dtype=np.int64).tobytes()]), pa.array([m.astype(np.int32).tobytes() if abs(m).max(initial=0) < 1 << 31 else m.tobytes()]), pa.array([d.tobytes()])],
                    names=["length", "ids", "v", "d"],
                )

            for batch in batches:
                for i, v in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                    ids, vectors = held.setdefault(len(v), ([], []))
                    ids.append(i), vectors.append(v)
                    if len(ids) == size:
                        yield row(len(v))
            for length in list(held):
                yield row(length)

        return pack

    layout = "length int, ids binary, v binary, d binary"
    parts = max(1, -(-queries // QUERY_BLOCK))
    asked = rows.where(F.col("id") % query_modulus == 0).repartition(parts, "id").mapInArrow(blocks(QUERY_BLOCK, True), layout)
    asked = written(asked.withColumn("qb", F.monotonically_increasing_id()), "queries")
    names = asked.select("length", "qb")  # a row for each block of queries
    have = rows.select("id", "v").mapInArrow(blocks(BLOCK, False), layout)
    per_length = names.groupBy("length").agg(F.collect_list("qb").alias("qbs"))
    pairs = have.join(per_length, "length").withColumn("qb", F.explode("qbs")).drop("qbs")
    met = pairs.join(asked.select("qb", *[F.col(c).alias("q_" + c) for c in ("ids", "v", "d")]), "qb").select("length", "ids", "v", "d", "qb", "q_ids", "q_v", "q_d")

    def numbers(raw: bytes, n: int, length: int) -> np.ndarray:
        wide = len(raw) == n * length * 8 and length
        return np.frombuffer(raw, dtype=np.int64 if wide else np.int32).astype(np.int64).reshape(n, length)

    def search(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            for length, ids, v, d, qb, q_ids, q_v, q_d in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = np.frombuffer(ids, dtype=np.int64)
                if qb not in best:
                    own = np.frombuffer(q_ids, dtype=np.int64)
                    best[qb] = (own, numbers(q_v, len(own), length), np.frombuffer(q_d, dtype=np.float64).reshape(len(own), -1), np.full((len(own), k, 2), NONE))
                own, q, dq, top = best[qb]
                search_block(q, dq, numbers(v, len(ids), length), np.frombuffer(d, dtype=np.float64).reshape(len(ids), -1), ids, own, top, radius, k)
        for own, _, _, top in best.values():
            real = top[:, :, 0] != NONE
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k).reshape(len(own), k)[real]), pa.array(top[:, :, 1][real]), pa.array(top[:, :, 0][real])], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # k rows for each task at most
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
