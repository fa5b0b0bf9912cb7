"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: its words and the beginnings of its words, which
catch inflected and composed forms. Terms that say nothing about the label are
screened out by their association with it on the training rows, so a long text
is not judged by its length. The machine adds weights of terms and, through a
vector for each term, the weights of all pairs of terms of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.llm.common import fold, texts_of

WORD = re.compile(r"\w+")
PREFIXES = (2, 3, 4, 5, 6)
HASH_BITS = 40  # of a term; the screened terms are few, so two of them hardly ever meet
TRAIN_ROWS = 20_000  # half of the labelled rows that the fit takes at most, of both labels together
TERMS = 2048  # terms of the machine
LEAST_ROWS = 4  # training rows that a term needs
CACHED_WORDS = 300_000


def word_terms(word: str) -> list[int]:
    """Hashes of a word and of its proper beginnings."""
    names = ["w" + word] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n]
    return [xxhash.xxh64_intdigest(x) >> (64 - HASH_BITS) for x in names]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Machine:
    """bias + sum of w over the terms of a text + sum of v_i . v_j over its pairs of terms."""

    terms: np.ndarray  # hashes, in order
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of 0/1 over ``terms``."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x)[0], -60, 60)))

    def raw(self, x: np.ndarray):
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s * s).sum(1) - x @ (self.v * self.v).sum(1)), s


def dense(docs: list[list[int]], terms: int) -> np.ndarray:
    x = np.zeros((len(docs), terms))
    for i, at in enumerate(docs):
        x[i, at] = 1
    return x


def fit(docs: list[list[int]], y: np.ndarray, terms: np.ndarray, rank: int = 4, steps: int = 1500, seed: int = 7) -> Machine:
    """Logistic loss by Adam on mini-batches; the same rows in the same order give the same machine.

    ``docs`` lists the places in ``terms`` that a row has.
    """
    rng = np.random.default_rng(seed)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    m = Machine(terms, float(np.log(rate / (1 - rate))), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), rank)))
    if not len(terms):
        return m
    p = {"b": np.array([m.bias]), "w": m.w, "v": m.v}
    first = {k: np.zeros_like(a) for k, a in p.items()}
    second = {k: np.zeros_like(a) for k, a in p.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(256, len(y)):
            order = rng.permutation(len(y))
        rows, order = order[:256], order[256:]
        x, t = dense([docs[i] for i in rows], len(terms)), y[rows]
        m.bias = float(p["b"][0])
        out, s = m.raw(x)
        g = (1 / (1 + np.exp(-np.clip(out, -60, 60))) - t) / len(rows)
        grad = {"b": np.array([g.sum()]), "w": x.T @ g + 1e-5 * p["w"], "v": x.T @ (g[:, None] * s) - (x.T @ g)[:, None] * p["v"] + 1e-4 * p["v"]}
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            p[k] -= 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    m.bias = float(p["b"][0])
    return m


def training_rows(df: DataFrame, labels: DataFrame, modulus: int, id_column: str, text_column: str, label_column: str, bound: int) -> DataFrame:
    """(_id, _y, text) of ``2 * bound`` labelled training rows at most, chosen by a hash of the id
    whatever the label, so a bounded sample has the true rate of the labels."""
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).cast("int").alias("_y"))
    known = known.where(fold(id_column, modulus) != 0).withColumnRenamed(id_column, "_id")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(2 * bound)  # of both labels together, so that their rate stays
    texts = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")  # 2 * bound rows at most


def screened(rows: DataFrame, limit: int, least: int) -> np.ndarray:
    """Hashes of the ``limit`` terms with the largest chi-squared against the label, among
    those in at least ``least`` rows and far beyond chance."""

    def count(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            found = [np.array([t for w in words_of(text) for t in word_terms(w)], dtype=np.int64) for text in texts_of(batch.column(2))]
            found = [np.unique(x) for x in found]
            terms, where = np.unique(np.concatenate(found), return_inverse=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            label = np.repeat(y, [len(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms), pa.array(np.bincount(where, minlength=len(terms))), pa.array(np.bincount(where, weights=label, minlength=len(terms)).astype(np.int64))],
                names=["term", "n", "n1"],
            )

    sizes = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    total, positive = int(sizes[0]), int(sizes[1])
    if not 0 < positive < total:
        return np.zeros(0, np.int64)
    terms = rows.mapInArrow(count, "term long, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(f"n >= {least} and n < {total}")
    off = F.col("n1") - F.col("n") * (positive / total)
    chi = off * off / (F.col("n") * (total - F.col("n")) * (positive / total * (total - positive) / total / total))
    top = terms.withColumn("chi", chi).where("chi > 20").orderBy(F.desc("chi"), "term").limit(limit)
    return np.sort(np.asarray(top.select("term").toArrow().column(0)).astype(np.int64))


def features(rows: DataFrame, terms: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """The screened terms of each training row, and the labels, by id."""

    def scan(batches):
        known = {int(t): i for i, t in enumerate(terms)}
        for batch in batches:
            found = [sorted({known[t] for w in words_of(text) for t in word_terms(w) if t in known}) for text in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, type=pa.list_(pa.int32()))], names=["_id", "_y", "at"])

    got = rows.mapInArrow(scan, f"_id {dict(rows.dtypes)['_id']}, _y int, at array<int>").orderBy("_id", "at").toArrow()
    return got.column("at").to_pylist(), np.asarray(got.column("_y").to_pylist(), dtype=np.float64)


def machine(df: DataFrame, labels: DataFrame, modulus: int = 5, bound: int = TRAIN_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Machine:
    """Learn from labelled rows of ``df`` whose fold is not 0, ``2 * bound`` rows at most."""
    rows = training_rows(df, labels, modulus, id_column, text_column, label_column, bound)
    terms = screened(rows, TERMS, LEAST_ROWS)
    return fit(*features(rows, terms), terms)


class Scorer:
    """Scores of texts by a machine; the terms of a word are looked up once."""

    def __init__(self, m: Machine):
        self.machine, self.known, self.cache = m, {int(t): i for i, t in enumerate(m.terms)}, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        cache, known, found = self.cache, self.known, []
        for text in texts:
            at: set[int] = set()
            for word in words_of(text):
                terms = cache.get(word)
                if terms is None:
                    if len(cache) > CACHED_WORDS:
                        cache.clear()
                    terms = cache[word] = tuple(known[t] for t in word_terms(word) if t in known)
                if terms:
                    at.update(terms)
            found.append(sorted(at))
        scores = np.zeros(len(found))
        for a in range(0, len(found), 512):
            scores[a:a + 512] = self.machine.scores(dense(found[a:a + 512], len(self.machine.terms)))
        return scores


def _sent(df: DataFrame, m: Machine):
    return df.sparkSession.sparkContext.broadcast((m.terms, m.bias, m.w, m.v))  # a few hundred KB: ``TERMS`` terms


def toxicity(
    df: DataFrame, labels: DataFrame, modulus: int = 5, bound: int = TRAIN_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic"
) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``df``.

    Learns from labelled rows whose fold is not 0, ``2 * bound`` of them at
    most; rows without a 0/1 label or without an id are not learnt from. Only
    the text enters a score. A null or empty text has no terms and gets the score
    of the bias; without both labels every score is that of the bias. Repeated
    ids and rows keep a row each; other columns are not read. An empty table
    gives an empty result.
    """
    sent = _sent(df, machine(df, labels, modulus, bound, id_column, text_column, label_column))
    kind = dict(df.dtypes)[id_column]

    def scan(batches):
        score = Scorer(Machine(*sent.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(texts_of(batch.column(1))))], names=["_id", "score"])

    scored = df.select(id_column, text_column).mapInArrow(scan, f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_column), (fold("_id", modulus) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(df: DataFrame, m: Machine, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """Rows of ``df`` whose score is below ``threshold``, with all their columns as they are."""
    sent, place = _sent(df, m), df.columns.index(text_column)

    def scan(batches):
        score = Scorer(Machine(*sent.value))
        for batch in batches:
            yield batch.filter(pa.array(score(texts_of(batch.column(place))) < threshold))

    return df.mapInArrow(scan, df.schema)
