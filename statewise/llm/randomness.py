"""Secret scans: fixed patterns, and a battery of randomness tests over token-like runs.

The battery asks whether a run of characters could come from a uniform source
over its alphabet: chi-squared of the symbols' frequencies, the number of runs
above and below the middle of the alphabet, and the correlation of neighbouring
symbols. Fisher's method joins the three. Ordinary words fail; keys and tokens
pass. Short runs fail and pass by chance more often, so the level that a run
must reach depends on its length: for each alphabet and length class, decoys of
the same length are cut from the ordinary words of the same documents and scored
alike, and the lowest level is taken at which decoys are at most ``rate`` of what
passes.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.llm.common import slices, texts_of, written

# Kinds and their patterns; the least length of what each must hold.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a match takes its whole run, so shorter runs are the failing ones
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
MIN_KINDS = 2  # of lower, upper, digits, signs: a run of one kind is a word or a number
LEVELS = 40  # score classes of the histogram
LEAST_LEVEL = LEVELS - 1 - 16  # a run less random than p = 1e-4 never passes
RATE = 0.05

# Alphabets, the narrowest first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
_SETS = [frozenset(a) for _, a in ALPHABETS]
_ORDER = [{c: i for i, c in enumerate(a)} for _, a in ALPHABETS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def alphabet_of(run: str) -> int:
    """Number of the narrowest alphabet that holds all characters of ``run``."""
    chars = frozenset(run)
    return next(i for i, s in enumerate(_SETS) if chars <= s)


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with ``k`` degrees (Wilson-Hilferty)."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(run: str, alphabet: int) -> float:
    """Combined p-value of the battery under a uniform source over the alphabet."""
    order = _ORDER[alphabet]
    x = np.array([order[c] for c in run if c in order], dtype=np.float64)
    n, size = len(x), len(order)
    if n < 4:
        return 0.0
    counts = np.bincount(x.astype(np.int64), minlength=size)
    p1 = _chi_tail(float(((counts - n / size) ** 2).sum() * size / n), size - 1)
    middle = (size - 1) / 2
    above = x > middle
    a = int(above.sum())
    b = n - a
    if a and b:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    else:
        p2 = 2.0 ** (1 - n)  # all on one side
    d = x - middle
    scale = (size * size - 1) / 12
    p3 = math.erfc(abs(float((d[1:] * d[:-1]).sum())) / scale / math.sqrt(2 * (n - 1)))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-fisher / 2) * (1 + fisher / 2 + fisher * fisher / 8)  # chi-squared with 6 degrees


def level(p: float) -> int:
    """Score class: 0 for the least random, by powers of ten of the p-value."""
    return int(max(0, min(LEVELS - 1, LEVELS - 1 + math.floor(4 * math.log10(max(p, 1e-30))))))


def length_class(n: int) -> int:
    return int(4 * math.log2(n))


def mixed_kinds(run: str) -> bool:
    kinds = any("a" <= c <= "z" for c in run) + any("A" <= c <= "Z" for c in run) + any("0" <= c <= "9" for c in run) + any(c in "+/_-=" for c in run)
    return kinds >= MIN_KINDS


def decoy(text: str, at: int, n: int) -> str | None:
    """``n`` letters of the ordinary words around place ``at``, without what parts them."""
    reach = 2 * n + 64
    while True:
        around = text[max(0, at - reach):at] + " " + text[at + n:at + n + reach]
        letters = "".join(w for w in re.findall(r"[A-Za-z]+", around) if len(w) < 20)
        if len(letters) >= n:
            return letters[:n]
        if reach > len(text):
            return None
        reach *= 4


def candidates(text: str) -> list[tuple[int, int, int, int, int | None]]:
    """(start, end, group, score class, score class of its decoy) of token-like runs."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group().rstrip("=")
        if not mixed_kinds(run):
            continue
        alphabet = alphabet_of(run)
        group = alphabet * 256 + length_class(len(run))
        other = decoy(text, m.start(), len(run))
        wide = 5 if alphabet in (0, 1, 2, 3, 4) else alphabet  # letters of any case
        out.append((m.start(), m.end(), group, level(randomness(run, alphabet)), None if other is None else level(randomness(other, alphabet if set(other) <= _SETS[alphabet] else wide))))
    return out


def thresholds(histogram: list[tuple[int, int, int, int]], rate: float) -> dict[int, int]:
    """Lowest score class of each group at which decoys are at most ``rate`` of what passes.

    ``histogram``: (group, score class, runs, decoys).
    """
    out: dict[int, int] = {}
    groups: dict[int, dict[int, tuple[int, int]]] = {}
    for group, score, runs, decoys in histogram:
        groups.setdefault(group, {})[score] = (runs, decoys)
    for group, scores in groups.items():
        runs = decoys = 0
        best = None
        for score in range(LEVELS - 1, LEAST_LEVEL - 1, -1):
            r, d = scores.get(score, (0, 0))
            runs, decoys = runs + r, decoys + d
            if runs and decoys <= rate * runs:
                best = score
        if best is not None:
            out[group] = best
    return out


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_RUNS = "array<struct<start:int,end:int,group:int,score:int,decoy:int>>"


def _scored(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(_id, base, runs): fixed patterns and scored token-like runs of each row."""

    def scan(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        run = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "group", "score", "decoy")]))
        for batch in slices(batches):
            base, runs = [], []
            for text in texts_of(batch.column(1)):
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in base_spans(text)])
                runs.append([{"start": a, "end": b, "group": g, "score": s, "decoy": d} for a, b, g, s, d in candidates(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, type=span), pa.array(runs, type=run)], names=["_id", "base", "runs"])

    return df.select(id_column, text_column).mapInArrow(scan, f"_id {dict(df.dtypes)[id_column]}, base {_SPANS}, runs {_RUNS}")


def _levels(scored: DataFrame, rate: float) -> dict[int, int]:
    each = scored.select(F.explode("runs").alias("r")).select("r.*")
    scores = each.select("group", "score", F.lit(1).alias("run"), F.lit(0).alias("d"))
    scores = scores.union(each.where("decoy is not null").select("group", F.col("decoy"), F.lit(0), F.lit(1)))
    # at most alphabets x length classes x score classes rows, whatever the corpus
    return thresholds([tuple(r) for r in scores.groupBy("group", "score").agg(F.sum("run"), F.sum("d")).collect()], rate)


def passing(base: list, runs: list, levels: dict[int, int]) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end) of a text, in order: the fixed patterns, and the runs that
    reach their level and overlap none of them."""
    new = [(a, 3, b) for a, b, g, s, _ in runs if s >= levels.get(g, LEVELS) and not any(x < b and a < y for x, _, y in base)]
    return sorted([*base, *new])


def scan_secrets(df: DataFrame, rate: float = RATE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, base, spans) for each row of ``df``: arrays of (start, kind, end), code points, end exclusive.

    ``base`` has the spans of the fixed patterns; ``spans`` has these and the
    token-like runs that the battery finds random and that no fixed pattern
    overlaps, by start, then kind. The levels come from all rows of ``df``. Null
    and empty texts have no spans; null and repeated ids and repeated rows keep a
    row each; other columns are not read. An empty table gives an empty result.
    """
    scored = written(_scored(df, id_column, text_column), "secrets")
    level_of = _levels(scored, rate)
    least = F.create_map(*[F.lit(x) for pair in level_of.items() for x in pair]) if level_of else F.create_map().cast("map<int,int>")
    good = F.filter(
        "runs",
        lambda r: (r["score"] >= F.coalesce(F.element_at(least, r["group"]), F.lit(LEVELS))) & ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])),
    )
    new = F.transform(good, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return scored.select(F.col("_id").alias(id_column), "base", F.array_sort(F.concat("base", new)).alias("spans"))


def redact(df: DataFrame, mark: str = "[secret]", rate: float = RATE, text_column: str = "text") -> DataFrame:
    """``df`` with each secret replaced by ``mark``: same rows and columns, null texts stay null.

    The first pass scores all runs of the table for the levels, the second
    rewrites the texts. Overlapping spans become one mark.
    """
    level_of = _levels(_scored(df.select(F.lit(0).alias("_id"), text_column), "_id", text_column), rate)
    place = df.columns.index(text_column)

    def rewrite(batches):
        for batch in slices(batches):
            out = []
            for text in batch.column(place).to_pylist():
                if text is not None:
                    at, parts = 0, []
                    for a, _, b in passing(base_spans(text), candidates(text), level_of):
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, type=batch.schema.field(place).type))

    return df.mapInArrow(rewrite, df.schema)


def kind_name(k):
    return F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)


def joined(spans: str):
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
