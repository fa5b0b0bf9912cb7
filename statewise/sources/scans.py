"""Table, text, nested and file scans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewise.functions.ordering import dealt


def scan_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    na_values: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Projected scan; NaN and the given text tokens become NULL."""
    reader = spark.read.options(**{k: str(v) for k, v in options.items()})
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", str(options.get("header", True)))
    df = reader.format(fmt).load(path)
    if columns is not None:
        df = df.select(*columns)
    return null_tokens(df, na_values)


def null_tokens(df: DataFrame, na_values: Sequence[str] = ()) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.StringType) and na_values:
            c = F.when(~c.isin(*na_values), c)
        out.append(c.alias(f.name))
    return df.select(*out)


# nested credible sets: one row per locus with arrays of structs


def locus_summary(df: DataFrame, locus: str = "locus", rows: str = "rows") -> DataFrame:
    """Lead variant, size and credible mass per locus. The lead is the first in
    (probability descending, id) order; arrays are one locus wide."""
    lead = F.array_min(F.transform(rows, lambda v: F.struct(
        (-v["posterior"]).alias("p"), v["variant_id"].alias("id"))))
    return df.select(
        locus,
        F.size(rows).cast("bigint").alias("credible_variants"),
        lead["id"].alias("lead_variant"),
        (-lead["p"]).alias("lead_posterior"),
    )


def locus_variants(df: DataFrame, locus: str = "locus", rows: str = "rows") -> DataFrame:
    return df.select(locus, F.explode(rows).alias("v")).select(locus, "v.*")


def locus_features(df: DataFrame, locus: str = "locus", features: str = "features") -> DataFrame:
    return df.select(locus, F.explode(features).alias("f")).select(locus, "f.*")


def threshold_masses(df: DataFrame, flags: Mapping[str, str], locus: str = "locus", rows: str = "rows") -> DataFrame:
    """Variants and posterior mass inside each credible-set flag."""

    def inside(label: str, flag: str) -> Column:
        kept = F.filter(rows, lambda v: v[flag])
        return F.struct(
            F.lit(label).alias("threshold"),
            F.size(kept).cast("bigint").alias("variants"),
            F.aggregate(kept, F.lit(0.0), lambda a, v: a + v["posterior"]).alias("mass"),
        )

    sets = F.array(*[inside(label, flag) for label, flag in flags.items()])
    return df.select(locus, F.explode(sets).alias("s")).select(locus, "s.*")


def scan_nested(spark: SparkSession, path: str, schema: T.StructType) -> dict[str, DataFrame]:
    """Summary, variants and features of nested JSON loci (multi-line files)."""
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    return {"summary": locus_summary(raw), "variants": locus_variants(raw), "features": locus_features(raw)}


# ragged gene-set lines


def parse_gene_sets(
    lines: DataFrame, universe: DataFrame | None = None, minimum: int = 1, maximum: int | None = None, text: str = "value"
) -> DataFrame:
    """``name<TAB>note<TAB>member...`` lines to (set_id, member), upper-cased,
    distinct, restricted to ``universe(member)``, with sets bounded in size."""
    parts = F.split(text, "\t")
    members = lines.select(
        F.element_at(parts, 1).alias("set_id"),
        F.explode(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))).alias("member"),
    ).select("set_id", F.upper("member").alias("member")).filter(F.col("member") != "")
    rows = lines.agg(F.coalesce(F.sum(F.greatest(F.size(parts) - 2, F.lit(0))), F.lit(0))).first()[0]
    members = dealt(members, rows, "set_id", "member").distinct()
    if universe is not None:
        members = dealt(members, rows, "member").join(universe.select("member").distinct(), "member", "left_semi")
    members = dealt(members, rows, "set_id")
    sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("set_size"))
    keep = F.col("set_size") >= minimum
    if maximum is not None:
        keep = keep & (F.col("set_size") <= maximum)
    return members.join(sizes.filter(keep), "set_id").select("set_id", "member", "set_size")


def scan_gene_sets(spark: SparkSession, path: str, **bounds) -> DataFrame:
    return parse_gene_sets(spark.read.text(path), **bounds)


# BED-like intervals


def parse_intervals(lines: DataFrame, text: str = "value") -> DataFrame:
    """Tab-separated chrom/start/end with comments and track lines skipped."""
    parts = F.split(text, "\t")
    skip = F.col(text).rlike(r"^(#|track|browser|\s*$)")
    return lines.filter(~skip).select(
        F.regexp_replace(parts[0], "^chr", "").alias("chrom"),
        parts[1].cast("bigint").alias("start_pos"),
        parts[2].cast("bigint").alias("end_pos"),
    )


def scan_intervals(spark: SparkSession, path: str) -> DataFrame:
    """BED or BED.gz. Ship large inputs as many or block-compressed files: one gzip file is one task."""
    return parse_intervals(spark.read.text(path))


# wide to long


def melt_matrix(df: DataFrame, ids: Sequence[str], columns: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Wide columns to (ids, feature, value) triplets without zeros and NULLs."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(ids), list(columns), feature, value).filter(F.col(value).isNotNull() & (F.col(value) != 0))


def to_long(df: DataFrame, ids: Sequence[str], array: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Array column to triplets, position as feature, zeros dropped."""
    return df.select(*ids, F.posexplode(array).alias(feature, value)).filter(F.col(value) != 0)


# catalogued heterogeneous files


def scan_catalog(
    spark: SparkSession, catalog: Sequence[Mapping], required: Sequence[str], optional: Mapping[str, str] = {},
) -> tuple[DataFrame, DataFrame]:
    """Union the catalogued files by name and list those with missing fields.

    Catalog entries hold ``name``, ``path``, ``fmt``, ``rename`` and constant
    ``attributes``; only schemas are looked at here, never rows.
    """
    tables, rejected = [], []
    for item in catalog:
        table = spark.read.format(item.get("fmt", "parquet")).options(**item.get("options", {})).load(item["path"])
        table = table.withColumnsRenamed(dict(item.get("rename", {})))
        missing = sorted(set(required) - set(table.columns))
        if missing:
            rejected.append((item["name"], ",".join(missing)))
            continue
        extra = [
            (F.col(c) if c in table.columns else F.lit(None)).cast(kind).alias(c) for c, kind in optional.items()
        ]
        fixed = [F.lit(v).alias(k) for k, v in item.get("attributes", {}).items()]
        tables.append(table.select(F.lit(item["name"]).alias("file_id"), *fixed, *required, *extra))
    if not tables:
        raise ValueError("no catalogued file has the required fields")
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows, spark.createDataFrame(rejected, "file_id string, reason string")


# frozen manifests


STREAM_BYTES = 8 << 20  # read at once


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of bytes ``start`` to ``stop`` of each path, a few megabytes in memory at a time."""
    for b in batches:
        found = []
        for path, start, stop in zip(*(x.to_pylist() for x in b.columns)):
            files, name = (pafs.LocalFileSystem(), path[5:]) if path.startswith("file:/") and not path.startswith("file://") else pafs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with files.open_input_file(name) as f:
                f.seek(start)
                while start < stop:
                    part = f.read(min(STREAM_BYTES, stop - start))
                    if not part:
                        break
                    digest.update(part)
                    start += len(part)
            found.append(digest.hexdigest() if start == stop else None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], ["path", "start", "stop", "digest"])


def _range_digests(ranges: DataFrame) -> DataFrame:
    """Adds ``digest`` to (path, start, stop); ranges are dealt out evenly, not by file."""
    tasks = max(1, min(ranges.count(), 4 * ranges.sparkSession.sparkContext.defaultParallelism))
    return ranges.select("path", "start", "stop").repartition(tasks).mapInArrow(_ranges, "path string, start long, stop long, digest string")


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)


def block_digests(spark: SparkSession, root: str, pattern: str = "*", block_bytes: int = 64 << 20) -> DataFrame:
    """(file, bytes, blocks, block_sha256) with blocks of a file hashed in parallel.

    ``block_sha256`` is the SHA-256 of the hexadecimal digests of the blocks in order, so
    it depends on ``block_bytes``. Files must be open to Arrow's file systems.
    """
    files = _listed(spark, root, pattern).select("path", "length")
    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0))
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("start"), "length")
    ranges = ranges.withColumn("start", F.col("start") * block_bytes).select("path", "start", F.least(F.col("start") + block_bytes, F.col("length")).alias("stop"))
    found = _range_digests(ranges).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "digest"))).alias("d"), F.max("stop").alias("bytes"))
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    return found.select(name, "bytes", F.size("d").alias("blocks"), F.sha2(F.array_join(F.transform("d", lambda x: x["digest"]), ""), 256).alias("block_sha256"))


def file_digests(spark: SparkSession, root: str, pattern: str = "*", whole_limit: int = 1 << 28) -> DataFrame:
    """Name, bytes and SHA-256 of every file.

    Files up to ``whole_limit`` bytes are rows of Spark's binary reader, from any
    store. Larger ones, which such a row can't hold, are streamed by one task each, for a
    plain SHA-256 has to follow the file from its start; ``block_digests`` has
    no such chain. Empty files are not rows of Spark's reader and so are missing here.
    """
    files = _listed(spark, root, pattern)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    small = files.filter(F.col("length") <= whole_limit).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole_limit).select("path", F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"))
    return small.unionByName(_range_digests(large).select(name, F.col("stop").alias("bytes"), F.col("digest").alias("sha256")))


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare digests with a manifest (file, bytes, sha256, corrected_sha256)."""
    m = manifest.select(
        "file",
        F.col("bytes").alias("expected_bytes"),
        F.coalesce("corrected_sha256", "sha256").alias("expected_sha256"),
    )
    joined = found.join(m, "file", "full_outer")
    status = (
        F.when(F.col("bytes").isNull(), "missing")
        .when(F.col("expected_bytes").isNull(), "unlisted")
        .when(F.col("bytes") != F.col("expected_bytes"), "size_mismatch")
        .when(F.col("sha256") == F.col("expected_sha256"), "verified")
        .otherwise("hash_mismatch")
    )
    return joined.select("file", "bytes", status.alias("status"))


def hashed_row(columns: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)


def fingerprint(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count and order-free digest (two 60-bit folds of the row hashes)."""
    h = hashed_row(keys)
    part = lambda i: F.conv(F.substring(h, i, 15), 16, 10).cast("bigint")
    folded = df.select(part(1).alias("a"), part(16).alias("b"))
    return folded.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor("a").alias("digest_xor"),
        F.sum(F.col("b") % 1_000_003).alias("digest_sum"),
    )
