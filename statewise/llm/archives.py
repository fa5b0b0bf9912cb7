"""Web archives: pages as ARC files, ARC converted to WARC, WARC read back.

Archives are files in the shared folder, written by Spark's text writer (so a lost
task leaves nothing behind) and read as binary files, one record at a time by its
declared length; no byte pattern inside a payload can end a record. An ARC file says in
its version block which fields its header lines have; a WARC record gets the
identifier, date, type and digests that follow from them.

Equal payloads are found by digest and length alone. Only these small rows are
grouped, and payloads move at most once, keyed by archive and offset, so a payload
shared by a third of the records makes no large group.

Defined cases: a null html is an empty payload; a null page_id has no id header and
comes back null; a null or empty url is ``unknown:``; white space and control
characters in a url become %20; repeated rows are records of their own, and of
records equal in page_id and payload the first by archive and offset is the
response; an archive without a version block is read as version 1; a header line that
can't be read ends its archive with one row that says so in ``problem``, as does a
record shorter than declared, and neither is converted; columns other than the three read are left out; an empty table gives
archives without records and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewise.llm.common import written
from statewise.session import scratch_path

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BATCH_BYTES = 4 << 20  # payload bytes in a batch of parsed records
BATCH_ROWS = 4096
NO_URL = "unknown:"
ID_HEADER = "X-Page-Id"
_PART = (1 << 33) - 1  # rows of a partition, as monotonically_increasing_id counts them


def write_lines(lines: DataFrame, end: str, path: str) -> None:
    """One gzip file for each partition; each row is followed by ``end``."""
    lines.write.options(maxRecordsPerFile=0, lineSep=end, compression="gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


# ---- writing ARC --------------------------------------------------------------------------

def page_blocks(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(uri, block): each page as the HTTP response that a crawler would have stored."""
    payload = F.coalesce(pages[html], F.lit(""))
    uri = F.regexp_replace(F.coalesce(pages[url], F.lit("")), r"[\x00-\x20\x7f]", "%20")
    lines = F.concat_ws(
        "\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit(f"{ID_HEADER}: "), pages[id].cast("string")), F.concat(F.lit("Content-Length: "), F.octet_length(payload)), F.lit("\r\n"),
    )
    return pages.select(F.when(uri == "", NO_URL).otherwise(uri).alias("uri"), F.concat(lines, payload).alias("block"))


def write_arc(blocks: DataFrame, version: int = 1, date: str = "19700101000000", ip: str = "0.0.0.0") -> str:
    """ARC files, one for each partition of ``blocks`` (uri, block); returns their folder."""
    path = scratch_path(blocks.sparkSession, "arc")
    size = F.octet_length("block").cast("string")
    more = {1: [], 2: [F.lit("200"), F.md5("block"), F.lit("-"), F.lit("0"), F.lit("pages.arc")]}[version]
    record = F.concat(F.concat_ws(" ", "uri", F.lit(ip), F.lit(date), F.lit("text/html"), *more, size), F.lit("\n"), F.col("block"))
    head = f"{version} 0 statewise\n{ARC_FIELDS[version]}\n"
    fill = "" if version == 1 else " 200 - - 0 pages.arc"
    name = F.concat(F.lit("filedesc://pages-"), F.shiftright("_at", 33), F.lit(f".arc {ip} {date} text/plain{fill} {len(head)}\n{head}\n"))
    first = F.col("_at").bitwiseAND(_PART) == 0  # the version block opens the file
    lines = blocks.withColumn("_at", F.monotonically_increasing_id()).select(F.when(first, F.concat(name, record)).otherwise(record))
    write_lines(lines, "\n", path)
    return path


# ---- reading ------------------------------------------------------------------------------

def opened(content: pa.Buffer) -> io.BufferedIOBase:
    raw = io.BytesIO(content) if content is not None else io.BytesIO()
    plain = raw.getbuffer()[:2] != b"\x1f\x8b"
    return raw if plain else gzip.GzipFile(fileobj=raw)


def base32_sha1(*parts: bytes) -> str:
    digest = hashlib.sha1()
    for p in parts:
        digest.update(p)
    return base64.b32encode(digest.digest()).decode()


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, its empty line included, and payload; a block of another kind is payload alone."""
    if block.startswith(b"HTTP/"):
        end = re.search(rb"\r?\n\r?\n", block)
        if end:
            return block[:end.end()], block[end.end():]
    return b"", block


def arc_records(stream) -> Iterator[dict]:
    """Records of one ARC file in order; ``problem`` is set on one that can't be read whole."""
    names, version = ["URL", "Archive-length"], None
    while True:
        offset = stream.tell()
        line = stream.readline()
        if not line:
            return
        line = line.strip(b"\r\n")
        if not line:
            continue
        fields = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(fields) < len(names) or not fields[-1].isdigit():
            yield {"offset": offset, "version": version, "fields": {"URL": line.decode("utf-8", "replace")}, "block": b"", "problem": "header line"}
            return
        size = int(fields[-1])
        block = stream.read(size)
        facts = dict(zip(names, fields))
        if version is None:  # the version block: its lines say what the other header lines hold
            lines = block.decode("utf-8", "replace").split("\n")
            if line.startswith(b"filedesc:") and lines[0][:1].isdigit() and len(lines) > 1:
                version, names = int(lines[0].split(" ")[0]), lines[1].split()
            else:
                version, names = 1, ARC_FIELDS[1].split()
            facts = dict(zip(names, line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)))
        yield {"offset": offset, "version": version, "fields": facts, "block": block, "problem": "truncated" if len(block) < size else None}


def warc_records(stream) -> Iterator[dict]:
    """Records of one WARC file in order."""
    while True:
        offset = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        fields, problem = {}, None
        if line.startswith(b"WARC/"):
            while (head := stream.readline()).strip():
                name, _, value = head.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if not size.isdigit():
            yield {"offset": offset, "fields": {}, "block": b"", "problem": "header line"}
            return
        block = stream.read(int(size))
        yield {"offset": offset, "fields": fields, "block": block, "problem": "truncated" if len(block) < int(size) else None}


def parsed(spark: SparkSession, path: str, records, columns, schema: str) -> DataFrame:
    """``columns(record)`` of every record of the files under ``path``, with archive and offset."""
    full = f"archive string, offset long, {schema}, problem string"
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in full.split(", "))])

    def batch(rows):
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for place, content in zip(b.column(0), b.column(1)):
                name = posixpath.basename(place.as_py())
                for r in records(opened(content.as_buffer())):
                    rows.append({"archive": name, "offset": r["offset"], "problem": r["problem"], **columns(r)})
                    size += len(r["block"])
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows, size = [], 0
        yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, full)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the ARC files (plain or gzip) under ``path``, by their declared lengths.

    Without ``payloads`` only their bytes and digests are kept.
    """
    def columns(r):
        head, payload = http_parts(r["block"])
        f = r["fields"]
        return {
            "version": r["version"], "uri": f.get("URL"), "ip": f.get("IP-address"), "date": f.get("Archive-date"), "mime": f.get("Content-type"),
            "head": head, "payload": payload if payloads else None, "payload_bytes": len(payload),
            "payload_digest": base32_sha1(payload), "block_digest": base32_sha1(r["block"]), "head_digest": base32_sha1(head),
        }

    schema = "version int, uri string, ip string, date string, mime string, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string, head_digest string"
    return parsed(spark, path, arc_records, columns, schema)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the WARC files (plain or gzip) under ``path``; payload facts are computed from what was read."""
    def columns(r):
        head, payload = http_parts(r["block"])
        f = r["fields"]
        return {
            "record_type": f.get("warc-type"), "record_id": f.get("warc-record-id"), "date": f.get("warc-date"), "uri": f.get("warc-target-uri"),
            "refers_to_id": f.get("warc-refers-to"), "stated_digest": f.get("warc-payload-digest"), "stated_block_digest": f.get("warc-block-digest"),
            "head": head, "payload": payload if payloads else None, "payload_bytes": len(payload),
            "payload_digest": base32_sha1(payload), "block_digest": base32_sha1(r["block"]),
        }

    schema = "record_type string, record_id string, date string, uri string, refers_to_id string, stated_digest string, stated_block_digest string, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string"
    return parsed(spark, path, warc_records, columns, schema)


def header(head: Column, name: str) -> Column:
    """A field of an HTTP head, null if it has none."""
    found = F.regexp_extract(head.cast("string"), rf"(?im)^{re.escape(name)}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


# ---- ARC to WARC --------------------------------------------------------------------------

def warc_date(date: Column) -> Column:
    """14 digits, or the leading part of them, as an ISO date; anything else is the epoch."""
    whole = F.concat(date, F.substring(F.lit("00000101000000"), F.length(date) + 1, F.lit(14)))
    iso = F.regexp_replace(whole, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    return F.when(date.rlike(r"^\d{4}(\d\d){0,5}$"), iso).otherwise("1970-01-01T00:00:00Z")


def record_id(*parts: Column) -> Column:
    """Name-based identifier (version 5 layout) of the record's archive, offset, uri and date."""
    h = F.sha1(F.concat_ws("\n", *parts))
    variant = F.translate(h.substr(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-5"), h.substr(14, 3), F.lit("-"), variant, h.substr(18, 3), F.lit("-"), h.substr(21, 12), F.lit(">"))


def as_warc(arc: DataFrame) -> DataFrame:
    """ARC records with the WARC identifier, date and type that follow from their header lines."""
    kind = F.when(F.col("uri").startswith("filedesc:"), "warcinfo").when(F.octet_length("head") > 0, "response").otherwise("resource")
    return arc.where("problem IS NULL").withColumns({
        "record_id": record_id(F.col("archive"), F.col("offset").cast("string"), F.col("uri"), F.col("date")), "warc_date": warc_date(F.col("date")), "record_type": kind,
    })


def first_of_equal(records: DataFrame, order: list[Column], min_bytes: int = 0) -> DataFrame:
    """(archive, offset, first) of records whose payload an earlier one has, by digest and length.

    ``first`` has the earlier record's id, uri and date; ``order`` says which is the
    earliest, ties fall to archive and offset. A hot payload is one group of a
    partial minimum, then one skewed key of a join that Spark splits.
    """
    r = records.where(f"record_type <> 'warcinfo' AND payload_bytes >= {min_bytes}").withColumn(
        "_at", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "archive", "offset", "record_id", "uri", "warc_date"))
    firsts = r.groupBy("payload_digest", "payload_bytes").agg(F.min("_at").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = r.select("archive", "offset", "payload_digest", "payload_bytes").join(firsts, ["payload_digest", "payload_bytes"])
    later = same.where("archive <> first.archive OR offset <> first.offset")
    return later.select("archive", "offset", F.struct("first.record_id", "first.uri", "first.warc_date").alias("first"))


def write_warc(records: DataFrame, repeats: DataFrame) -> str:
    """WARC files of ``as_warc`` records; those in ``repeats`` become revisits without payload."""
    path = scratch_path(records.sparkSession, "warc")
    r = records.join(repeats, ["archive", "offset"], "left")
    revisit = F.col("first").isNotNull()
    text = lambda c: F.col(c).cast("string")
    block = F.when(revisit, text("head")).otherwise(F.concat(text("head"), text("payload")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    kind = F.when(F.col("record_type") == "response", "application/http; msgtype=response").when(F.col("record_type") == "warcinfo", "text/plain").otherwise(F.coalesce("mime", F.lit("application/octet-stream")))
    uri = F.when(F.col("record_type") != "warcinfo", F.col("uri"))
    lines = F.concat_ws(
        "\r\n", F.lit(WARC_VERSION), field("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("record_type"))), field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("warc_date")), field("WARC-Target-URI", uri), field("WARC-IP-Address", F.when(uri.isNotNull(), F.col("ip"))),
        field("WARC-Filename", F.when(uri.isNull(), F.col("archive"))),
        field("WARC-Payload-Digest", F.when(uri.isNotNull(), F.concat(F.lit("sha1:"), "payload_digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("head_digest")).otherwise(F.col("block_digest")))),
        field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)), field("WARC-Refers-To", F.col("first.record_id")),
        field("WARC-Refers-To-Target-URI", F.col("first.uri")), field("WARC-Refers-To-Date", F.col("first.warc_date")),
        field("Content-Type", kind), field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    write_lines(r.select(F.concat(lines, block)), "\r\n\r\n", path)
    return path


def converted(spark: SparkSession, arc: str, order: list[Column] | None = None, min_bytes: int = 0) -> str:
    """The ARC files under ``arc`` as WARC files; returns their folder."""
    facts = written(as_warc(read_arc(spark, arc, payloads=False)).drop("payload"), "arc-facts")
    repeats = written(first_of_equal(facts, order or [], min_bytes), "repeats")  # its size known, Spark broadcasts a small one and payloads stay
    return write_warc(as_warc(read_arc(spark, arc)), repeats)


def resolved(back: DataFrame) -> DataFrame:
    """Records read back; a revisit gets the payload facts and the id of the response that it names."""
    named = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), *(F.col(c).alias(f"_{c}") for c in ("page_id", "payload_bytes", "payload_digest")))
    of = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    return back.join(named, "refers_to_id", "left").select("page_id", of("payload_bytes"), of("payload_digest"), "record_type", F.col("_page_id").alias("refers_to"), "record_id", "uri", "date", "stated_digest")


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", version: int = 1, min_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: one row for each page.

    Of equal payloads of ``min_bytes`` or more, that of the smallest id is the response
    (null ids last). Columns: the id, payload_bytes, payload_digest, record_type,
    refers_to, and record_id, uri, date, stated_digest.
    """
    spark, kind = pages.sparkSession, pages.schema[id].dataType
    page_id = header(F.col("head"), ID_HEADER).cast(kind)
    warc = converted(spark, write_arc(page_blocks(pages, id, url, html), version), [page_id.isNull(), page_id], min_bytes)
    back = written(read_warc(spark, warc, payloads=False).where("record_type <> 'warcinfo'").withColumn("page_id", page_id).drop("head", "payload"), "warc-facts")
    return resolved(back).withColumnRenamed("page_id", id)
