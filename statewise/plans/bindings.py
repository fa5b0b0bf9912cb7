"""Views over the given tables that stand in for the domain inputs.

Each view is one SQL text with a few dialect-dependent pieces. Spark reads it
through ``Bound.view`` and the SQL counterpart uses it as a CTE. Measures are
built from integer sums so both engines compute the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHIFT = 0.4937  # keeps decimal fractions away from the rounding boundary


def q6(c: Column | str, digits: int = 6) -> Column:
    """Round to 6 places the same way in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.floor(c * scale + SHIFT) / scale


class Dialect:
    def __init__(self, spark: bool, sf_dir: str = ""):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, table: str) -> str:
        return f"parquet.`{self.sf_dir}/{table}.parquet`" if self.spark else table

    def q6(self, x: str, digits: int = 6) -> str:
        return f"(floor(({x}) * 1e{digits} + {SHIFT}) / 1e{digits})"

    def draw(self, modulus, *parts) -> str:
        label = f"concat_ws('|', {', '.join(str(p) for p in parts)})"
        if self.spark:
            return f"(cast(conv(substr(md5({label}),1,15),16,10) as bigint) % {modulus})"
        return f"(('0x'||substr(md5({label}),1,15))::BIGINT % {modulus})"

    def uniform(self, *parts) -> str:
        bits = self.draw(1 << 60, *parts)
        return f"(({bits} + 0.5) / {float(1 << 60)!r})"

    def fold(self, key: str, k: int, digits: int = 16) -> str:
        if self.spark:
            return (f"cast(cast(conv(substr(sha2(cast({key} as string),256),1,{digits}),16,10) "
                    f"as decimal(20,0)) % {k} as bigint)")
        return f"(('0x'||substr(sha256(cast({key} as varchar)),1,{digits}))::UBIGINT % {k})::BIGINT"

    def epoch(self, ts: str) -> str:
        return f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})" if self.spark else f"cast(floor(epoch({ts})) as bigint)"

    def text(self, x: str) -> str:
        return f"cast({x} as string)" if self.spark else f"cast({x} as varchar)"

    def pick(self, options: str, index: str) -> str:
        """Element ``index`` (0-based) of a string of one-letter options."""
        return f"substr('{options}', cast({index} as int) + 1, 1)"

    def view(self, name: str) -> str:
        return VIEWS[name](self)

    def with_views(self, names: list[str], body: str) -> str:
        parts = ", ".join(f"{n} AS ({self.view(n)})" for n in self._closure(names))
        return f"WITH {parts} {body}" if not body.lstrip().startswith(",") else f"WITH {parts} {body}"

    def _closure(self, names: list[str]) -> list[str]:
        order: list[str] = []
        for n in names:
            for need in [*NEEDS.get(n, ()), n]:
                for deep in self._closure([need]) if need != n else [n]:
                    if deep not in order:
                        order.append(deep)
        return order


DUCK = Dialect(spark=False)
CENTS = "cast(round(l_discount * 100) as bigint)"


def _summary(d: Dialect) -> str:
    """Target x state summary with derived NULLs in the flags."""
    return f"""
    SELECT s.target, s.state, s.cells, s.downstream, s.effect,
      CASE WHEN p_size = 50 THEN NULL ELSE p_retailprice END AS base_mean,
      CASE WHEN s.target % 97 = 0 THEN NULL ELSE s.guides END AS guides,
      CASE WHEN s.target % 13 = 0 THEN NULL ELSE abs(s.dsum - 5 * s.cells) > 0 END AS on_target,
      CASE WHEN s.target % 17 = 0 THEN NULL ELSE p_size < 3 END AS low_expression,
      CASE WHEN s.target % 19 = 0 THEN NULL ELSE s.open_lines = s.cells END AS neighbor_hit,
      CASE WHEN s.target % 23 = 0 THEN NULL ELSE p_size = 7 END AS distal_hit,
      CASE WHEN p_size > 45 THEN NULL ELSE p_brand END AS cluster
    FROM (SELECT l_partkey AS target, l_returnflag AS state, count(*) AS cells,
            count(CASE WHEN l_quantity > 25 THEN 1 END) AS downstream,
            count(distinct l_suppkey) AS guides, sum({CENTS}) AS dsum,
            (cast(sum({CENTS}) as double) / count(*) - 5) / 100 AS effect,
            sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_lines
          FROM {d.t('lineitem')} GROUP BY l_partkey, l_returnflag) s
    JOIN {d.t('part')} ON p_partkey = s.target"""


def _passed(d: Dialect) -> str:
    """Summary rows after quality control (cells >= 3, guides >= 2)."""
    src = f"({_summary(d)}) q0" if d.spark else "summary"
    return f"""
    SELECT * FROM {src} WHERE coalesce(on_target, false) AND NOT coalesce(low_expression, true)
      AND NOT coalesce(neighbor_hit, true) AND NOT coalesce(distal_hit, true)
      AND guides >= 2 AND cells >= 3 AND base_mean IS NOT NULL AND effect IS NOT NULL"""


def _effects(d: Dialect) -> str:
    """Sparse signed responses: target, state, feature, value (zeros absent)."""
    return f"""
    SELECT l_suppkey AS target, l_returnflag AS state, concat('F', {d.text('l_partkey % 40')}) AS feature,
      (cast(sum({CENTS}) as double) / count(*) - 5) / 100 AS value
    FROM {d.t('lineitem')} GROUP BY l_suppkey, l_returnflag, concat('F', {d.text('l_partkey % 40')})
    HAVING abs(sum({CENTS}) - 5 * count(*)) > count(*)"""


def _tests(d: Dialect) -> str:
    """Per target x state x feature test rows: effect, adjusted p, all kept."""
    return f"""
    SELECT l_suppkey AS target, l_returnflag AS state, concat('F', {d.text('l_partkey % 40')}) AS feature,
      (cast(sum({CENTS}) as double) / count(*) - 5) / 100 AS effect,
      1.0 / (1 + count(*) * (1 + abs(sum({CENTS}) - 5 * count(*)))) AS adj_p
    FROM {d.t('lineitem')} GROUP BY l_suppkey, l_returnflag, concat('F', {d.text('l_partkey % 40')})"""


def _tensor(d: Dialect) -> str:
    """Target x state x module scores (8 modules) from the line items."""
    return f"""
    SELECT l_suppkey AS target, l_returnflag AS state, l_partkey % 8 AS module,
      cast(sum({CENTS} - 5) as double) / 100 AS score
    FROM {d.t('lineitem')} GROUP BY l_suppkey, l_returnflag, l_partkey % 8"""


def _edges(d: Dialect) -> str:
    """Signed response edges per state: source, state, response, effect, direction."""
    return f"""
    SELECT l_suppkey AS source, l_returnflag AS state, l_partkey AS response,
      (cast(sum({CENTS}) as double) / count(*) - 5) / 100 AS effect,
      cast(sign(sum({CENTS}) - 5 * count(*)) as int) AS direction
    FROM {d.t('lineitem')} GROUP BY l_suppkey, l_returnflag, l_partkey"""


def _priors(d: Dialect) -> str:
    """Prior signed edges with resources over the keys that the responses have; several rows per pair."""
    return f"""
    SELECT l_partkey AS source, cast((l_partkey * 7 + l_suppkey) % parts + 1 as bigint) AS response, CASE WHEN {CENTS} > 5 THEN 1 WHEN {CENTS} < 5 THEN -1 ELSE 0 END AS direction,
      CASE l_linenumber % 4 WHEN 0 THEN 'curated-a' WHEN 1 THEN 'curated-b' WHEN 2 THEN 'motif-x' ELSE 'regulon-y' END AS resource
    FROM {d.t('lineitem')} CROSS JOIN (SELECT max(p_partkey) AS parts FROM {d.t('part')}) pm"""


def _points(d: Dialect) -> str:
    return f"""
    SELECT event_id AS point_id, user_id AS chrom, {d.epoch('ts')} AS pos, value AS weight
    FROM {d.t('events')} WHERE event_type = 'click'"""


def _spans(d: Dialect) -> str:
    return f"""
    SELECT event_id AS span_id, user_id AS chrom, {d.epoch('ts')} AS start_pos,
      {d.epoch('ts')} + cast(floor(value * 60) as bigint) + 1 AS end_pos,
      CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'marked' END AS assay
    FROM {d.t('events')} WHERE event_type = 'view'"""


def _scored(d: Dialect) -> str:
    """Binary outcome with two scores, grouped by source."""
    return f"""
    SELECT l.doc_id AS unit, d.source AS cluster, d.lang AS dataset, cast(l.quality as int) AS y,
      cast(d.n_chars % 1000 as double) / 1000 AS score_a,
      cast({d.draw(400, "'noise'", 'l.doc_id')} as double) / 400 AS score_b
    FROM {d.t('labels')} l JOIN {d.t('documents')} d ON l.doc_id = d.doc_id"""


def _gwas(d: Dialect) -> str:
    """Association rows with text keys, missing values and bad rows."""
    return f"""
    SELECT l_suppkey % 25 + 1 AS chrom_no, l_orderkey AS pos, l_linenumber,
      {d.pick('ACGT', 'l_partkey % 4')} AS effect_allele,
      {d.pick('ACGTN', 'l_suppkey % 5')} AS other_allele,
      CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE 0.9 + l_discount * 2 END AS odds_ratio,
      CASE WHEN l_partkey % 53 = 0 THEN 0.0 ELSE l_tax + 0.01 END AS standard_error,
      CASE WHEN l_suppkey % 31 = 0 THEN NULL ELSE l_quantity / 50.5 END AS eaf,
      pow(10.0, -l_quantity / 4) AS p_value, 0.5 + l_tax * 6 AS info,
      cast(1000 + l_partkey as bigint) AS n, concat('rs', {d.text('l_partkey * 10 + l_linenumber')}) AS rsid
    FROM {d.t('lineitem')}"""


def _cis(d: Dialect) -> str:
    return f"""
    SELECT l_partkey AS snp, 1 + l_partkey % 22 AS snp_chrom, l_suppkey AS gene,
      {d.pick('ACGT', 'l_partkey % 4')} AS assessed, {d.pick('CGTA', 'l_partkey % 4')} AS other,
      cast(sum({CENTS} - 5) as double) / 2 + (CASE WHEN l_suppkey % 2 = 0 THEN 0.25 ELSE -0.25 END) AS z,
      1.0 / (1 + count(*)) AS fdr
    FROM {d.t('lineitem')} WHERE l_linestatus = 'F' GROUP BY l_partkey, l_suppkey"""


def _trans(d: Dialect) -> str:
    return f"""
    SELECT l_partkey AS snp, concat('F', {d.text('l_orderkey % 40')}) AS gene,
      {d.pick('ACGT', 'l_partkey % 4')} AS assessed,
      CASE WHEN l_partkey % 9 = 0 THEN 'A' ELSE {d.pick('CGTA', 'l_partkey % 4')} END AS other,
      cast(sum({CENTS} - 5) as double) / 3 + 0.1 AS z, 1.0 / (1 + sum({CENTS})) AS p
    FROM {d.t('lineitem')} WHERE l_linestatus = 'O' GROUP BY l_partkey, concat('F', {d.text('l_orderkey % 40')}),
      {d.pick('ACGT', 'l_partkey % 4')}, CASE WHEN l_partkey % 9 = 0 THEN 'A' ELSE {d.pick('CGTA', 'l_partkey % 4')} END"""


def _cells(d: Dialect) -> str:
    """Cells with label sets: order -> brands seen on it."""
    return f"""
    SELECT o_orderpriority AS dataset, l_orderkey AS cell_id, p_brand AS label
    FROM {d.t('lineitem')} JOIN {d.t('part')} ON p_partkey = l_partkey
    JOIN {d.t('orders')} ON o_orderkey = l_orderkey"""


def _dense(d: Dialect) -> str:
    """Dense vectors in long form, 64 axes."""
    if d.spark:
        return f"""SELECT vec_id, label, axis, cast(v as double) AS v FROM {d.t('embeddings')}
        LATERAL VIEW posexplode(embedding) e AS axis, v"""
    return """SELECT vec_id, label, axis - 1 AS axis, cast(embedding[axis] as double) AS v
    FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS axis FROM embeddings)"""


def _series(d: Dialect) -> str:
    """Expression-like series: value per time step and feature (brand)."""
    return f"""
    SELECT cast(l_orderkey % 200 as bigint) AS step, p_brand AS feature, cast(sum({CENTS}) as double) / count(*) AS x
    FROM {d.t('lineitem')} JOIN {d.t('part')} ON p_partkey = l_partkey GROUP BY l_orderkey % 200, p_brand"""


VIEWS = {
    "summary": _summary, "passed": _passed, "effects": _effects, "tests": _tests, "tensor": _tensor,
    "edges": _edges, "priors": _priors, "points": _points, "spans": _spans, "scored": _scored,
    "gwas": _gwas, "cis": _cis, "trans": _trans, "cells": _cells, "dense": _dense, "series": _series,
}
NEEDS = {"passed": ("summary",)}


class Bound:
    """The given tables and the views over them, for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")
        self.dialect = Dialect(True, self.sf_dir)

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str) -> DataFrame:
        return self.spark.sql(self.dialect.view(name))
