"""Registered queries of the corpus operators: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewise.llm import pfair, randomness
from statewise.llm.archives import archived
from statewise.llm.attention import language_scores
from statewise.llm.common import table
from statewise.llm.fim import fill_in_middle
from statewise.llm.html_tree import main_text
from statewise.llm.lloyd import vector_codes
from statewise.llm.phrases import without_repeats
from statewise.llm.pivots import top_k
from statewise.llm.seeds import contamination
from statewise.llm.simhash import near_duplicates
from statewise.llm.token_counts import token_counts
from statewise.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONTEXT_TOKENS = 1024


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CONTEXT_TOKENS)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, segment=32, distance=2)


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = randomness.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(randomness.joined("base"), 256).alias("base_sha256"), randomness.joined("spans").alias("spans"),
    )


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pfair.mixed(documents, pfair.tempered(documents)).select("doc_id", "source", "mix_frame", "mix_slot")


@query
def op4_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, query_modulus=50, scale=256)


ORACLES["op4_pivot_search"] = """
WITH r AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM r q JOIN r c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"), size=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), modulus=7, remainder=2)


ORACLES["op9_mixing"] = """
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, coalesce(length(text), 0) AS size FROM documents),
w AS (SELECT k, count(*) AS blocks, pow(greatest(sum(size), 1)::DOUBLE, 0.5) AS weight FROM d GROUP BY k),
x AS (SELECT *, weight / sum(weight) OVER () * 200 AS exact FROM w),
y AS (SELECT *, greatest(floor(exact), 1)::BIGINT AS low FROM x),
sh AS (SELECT k, blocks, low + CASE WHEN row_number() OVER (ORDER BY exact - low DESC, k) <= 200 - sum(low) OVER () THEN 1 ELSE 0 END AS share FROM y),
cut AS (SELECT 0::BIGINT AS a UNION SELECT floor(blocks / share)::BIGINT FROM sh UNION SELECT ceil(blocks / share)::BIGINT FROM sh),
kind AS (SELECT a, b FROM (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM cut) WHERE b IS NOT NULL),
counts AS (SELECT a, b, list(k ORDER BY k) AS ks, list(least(share, greatest(blocks - a * share, 0)) ORDER BY k) AS c FROM kind, sh GROUP BY a, b),
total AS (SELECT *, list_sum(c)::BIGINT AS n FROM counts),
sim AS (
  SELECT a, n, c, 0::BIGINT AS slot, list_transform(c, lambda v: 0::BIGINT) AS done, 0::BIGINT AS chosen FROM total
  UNION ALL
  SELECT a, n, c, slot + 1, list_transform(range(1, len(c) + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT *, list_min(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN done[i] < c[i] AND floor(done[i] * n::DOUBLE / nullif(c[i], 0)) <= slot
    THEN ceil((done[i] + 1) * n::DOUBLE / nullif(c[i], 0))::BIGINT * 100000 + i END)) % 100000 AS pick FROM sim WHERE slot < n)
),
base AS (SELECT a, b, n, ks, coalesce(sum((b - a) * n) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM total),
served AS (SELECT s.a, b.b, b.n, b.base, b.ks[s.chosen] AS k, s.slot - 1 AS slot, row_number() OVER (PARTITION BY s.a, s.chosen ORDER BY s.slot) - 1 AS nth FROM sim s JOIN base b ON s.a = b.a WHERE s.slot > 0),
ranked AS (SELECT doc_id, source, d.k, share, row_number() OVER (PARTITION BY d.k ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS r FROM d JOIN sh ON d.k = sh.k)
SELECT r.doc_id, r.source, (r.r // r.share)::BIGINT AS mix_frame, (s.base + (r.r // r.share - s.a) * s.n + s.slot)::BIGINT AS mix_slot
FROM ranked r JOIN served s ON r.k = s.k AND r.r % r.share = s.nth AND r.r // r.share >= s.a AND r.r // r.share < s.b
"""


ORACLES["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
n AS (SELECT doc_id, p, word, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s FROM x),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(s, ' ') ORDER BY doc_id, p) AS r FROM n WHERE len(s) = 20),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM f, range(20) t(j) WHERE r > 1),
kept AS (SELECT x.doc_id, count(*) AS k, string_agg(word, ' ' ORDER BY x.p) AS line FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50, texts=False).drop("output")


ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
x AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(o) AS output_sha256, sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN regexp_replace(o, '^<P>([\s\S]*)<S>([\s\S]*)<M>([\s\S]*)$', '\1\3\2')
    ELSE regexp_replace(o, '^<S>([\s\S]*)<P>([\s\S]*)<M>([\s\S]*)$', '\2\3\1') END) AS restored_sha256
FROM o
"""


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archived(table(spark, sf_dir, "pages"), version=1, min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op13_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS r, sha1(h) AS x FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || x[5 * i + 1:5 * i + 5])::BIGINT) AS v FROM f)
SELECT page_id, octet_length(h) AS payload_bytes,
  array_to_string(list_transform(v, lambda y: array_to_string(list_transform([32768, 1024, 32, 1], lambda d: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[y // d % 32 + 1]), '')), '') AS payload_digest,
  CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first END AS refers_to
FROM g
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = vector_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _code_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd rounds unrolled: a is an assignment, b the codebooks after it."""
    steps = [f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM k, range({parts}) t(p)),
h AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM m JOIN h USING (vec_id) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, x, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT vec_id, m.p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d FROM m JOIN b{r} b ON m.p = b.p)
  GROUP BY vec_id, p, x)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS total, count(*) AS n FROM a{r}, range(1, len(x) + 1) t(i) GROUP BY p, e, i) GROUP BY p, e) s
  ON b.p = s.p AND b.e = s.e)""")
    steps.append(f"""c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN k USING (vec_id)""")
    return ",\n".join(steps)


ORACLES["op12_vector_codes"] = _code_sql()
