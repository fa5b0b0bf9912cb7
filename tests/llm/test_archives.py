"""Fill-in-middle, archives and vector codes against plain Python."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from helpers import document, texts

from statewise.llm import archives, fim, lloyd


def multiset(rows):
    return Counter(map(tuple, rows))


# ---- 11 -----------------------------------------------------------------------------------

def in_the_middle(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("piece", [1 << 16, 3])
def test_fill_in_middle_equals_plain_python(spark, odd, none, small, monkeypatch, piece):
    """Short pieces put marks across the borders of pieces."""
    monkeypatch.setattr(fim, "PIECE", piece)
    marked = ["\n", "a\n\nb", "x<P", "<P<S<M\n><", "<\n<P\n<S\n<M\nP>\nS>\nM>\n", "has <M> inside\nit", "no end", "end\n", "\U0001f600\né\n" * 30]
    plain = spark.createDataFrame([document(i, t) for i, t in enumerate(marked * 5)], odd.schema).repartition(3)
    for df in (odd, plain) if piece == 3 else (odd, plain, small):
        df = df.withColumn("text", df.text.substr(1, 3000)) if piece == 3 else df
        got = fim.fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")
        want = [in_the_middle(i, t) + (t,) for i, t in texts(df)]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert multiset(got.collect()) == multiset((*w[:6], sha(w[5]), sha(w[6])) for w in want)
    assert fim.fill_in_middle(none).count() == 0
    assert {r.output for r in fim.fill_in_middle(odd, texts=False).collect()} == {None}
    assert {r.form for r in fim.fill_in_middle(odd, rate=0).collect()} == {"plain"}


def test_pieces_hold_whole_units_and_meet_once(spark, monkeypatch):
    monkeypatch.setattr(fim, "PIECE", 10)
    text = "one\ntwo\nthree four five six\nlast"
    assert list(fim.chunks(text, 0, len(text))) == ["one\ntwo\n", "three four", " five six\n", "last"]
    rdd = fim.output_pieces(spark.createDataFrame([document(i, text) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long, _row string, score double, _id int"))
    parts = rdd.glom().collect()
    rows = [{k[0] for k, _ in p} for p in parts]
    assert sum(map(len, rows)) == 20 == len(set().union(*rows))
    assert all([k for k, _ in p] == sorted(k for k, _ in p) for p in parts)
    again = rdd.mapPartitions(lambda it: fim.assembled(it, False), True).repartitionAndSortWithinPartitions(rdd.getNumPartitions(), fim.row_of)
    assert again.toDebugString().decode().count("ShuffledRDD") == rdd.toDebugString().decode().count("ShuffledRDD") == 1


# ---- 13 -----------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, head string, payload string, offset int, first string"
ENDS = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nhttp://x 0.0.0.0 19700101000000 text/html 5\n"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize(("version", "least"), [(1, 0), (2, 0), (1, 5)])
def test_archived_pages_come_back(spark, version, least):
    long = "<p>\u00e9\U0001f600</p>" * 30_000
    html = [None, "", "same", "same", ENDS, ENDS, long, "HTTP/1.1 no head", "\r\n\r\n", "same page"]
    rows = [(i, f"http://a b/{i % 3}\n", h) for i, h in enumerate(html)] + [(None, None, "same"), (None, "", "alone"), (3, "u", "same page"), (3, "u", "same page")]
    pages = spark.createDataFrame([(*r, "h", "p", 1, "f") for r in rows], PAGES).repartition(3)
    got = archives.archived(pages, version=version, min_bytes=least)
    want, seen = Counter(), {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (h or "").encode()
        revisit = payload in seen and len(payload) >= least
        want[(i, len(payload), sha1(payload), "revisit" if revisit else "response", seen[payload] if revisit else None)] += 1
        seen.setdefault(payload, i)
    assert multiset(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want
    assert all(r.stated_digest == "sha1:" + r.payload_digest for r in got.collect())
    assert {r.uri for r in got.collect()} == {"http://a%20b/0%20", "http://a%20b/1%20", "http://a%20b/2%20", "unknown:", "u"}
    assert archives.archived(pages.limit(0), version=version).count() == 0


def test_legacy_archives_of_both_versions(spark, tmp_path):
    """Hand-made files: header lines as their version block says, cut and broken ones told apart."""
    body = b"HTTP/1.0 200 OK\nServer: x\n\n\xff\xfe raw"
    one = b"filedesc://one.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    one = one.replace(b" 76\n", b" %d\n" % len(one.split(b"\n", 1)[1].removesuffix(b"\n")))
    one += b"\nhttp://a/ 1.2.3.4 199609231421 text/html %d\n%s\n\ndns:a 1.2.3.4 x text/dns 4\nA\n\nB\n" % (len(body), body)
    block = b"2 0 Someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://two.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 two.arc %d\n%s\n" % (len(block), block)
    two += b"http://b c/ 5.6.7.8 20010203040506 text/html 200 abc - 99 two.arc %d\n%s" % (len(body) + 50, body)
    (tmp_path / "one.arc").write_bytes(one)
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(two[:60]) + gzip.compress(two[60:]))
    (tmp_path / "bad.arc").write_bytes(b"http://c/ 1.1.1.1 19990101 text/html 2\nhi\nnot a header\n")
    (tmp_path / "empty.arc").write_bytes(b"")
    arc = archives.read_arc(spark, str(tmp_path))
    rows = {(r.archive, r.uri): r for r in arc.collect()}
    assert {k: (r.version, r.problem) for k, r in rows.items()} == {
        ("one.arc", "filedesc://one.arc"): (1, None), ("one.arc", "http://a/"): (1, None), ("one.arc", "dns:a"): (1, None),
        ("two.arc.gz", "filedesc://two.arc"): (2, None), ("two.arc.gz", "http://b c/"): (2, "truncated"),
        ("bad.arc", "http://c/"): (1, None), ("bad.arc", "not a header"): (1, "header line"),
    }
    page = rows["one.arc", "http://a/"]
    assert (bytes(page.payload), page.payload_digest, page.block_digest, page.ip) == (b"\xff\xfe raw", sha1(b"\xff\xfe raw"), sha1(body), "1.2.3.4")
    assert rows["two.arc.gz", "http://b c/"].date == "20010203040506"
    back = archives.read_warc(spark, archives.converted(spark, str(tmp_path), [F.col("uri")])).collect()
    assert Counter((r.record_type, r.uri, r.date) for r in back) == Counter([
        ("warcinfo", None, "1996-09-23T14:21:03Z"), ("response", "http://a/", "1996-09-23T14:21:00Z"), ("resource", "dns:a", "1970-01-01T00:00:00Z"), ("warcinfo", None, "2001-01-01T00:00:00Z"), ("resource", "http://c/", "1999-01-01T00:00:00Z"),
    ])
    got = next(r for r in back if r.uri == "http://a/")
    assert (bytes(got.head) + bytes(got.payload), got.stated_block_digest) == (body, "sha1:" + sha1(body))
    assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", got.record_id) and len({r.record_id for r in back}) == 5


def test_dates_of_any_length(spark):
    dates = ["1999", "199912", "19991231", "1999123123", "199912312359", "19991231235958", "1", "19991", "x", "", None]
    got = spark.createDataFrame([(d,) for d in dates], "d string").select(archives.warc_date(F.col("d")).alias("w"))
    epoch = "1970-01-01T00:00:00Z"
    assert [r.w for r in got.collect()] == ["1999-01-01T00:00:00Z", "1999-12-01T00:00:00Z", "1999-12-31T00:00:00Z", "1999-12-31T23:00:00Z", "1999-12-31T23:59:00Z", "1999-12-31T23:59:58Z"] + [epoch] * 5


# ---- 12 -----------------------------------------------------------------------------------

def codes_of(rows, parts, entries, rounds, scale=4096):
    """(id, label, vector) rows in plain integers: codes, errors, and the digest of the codebooks."""
    good = [(i, l, v) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n = Counter(len(v) for _, _, v in good)
    d = max(n, key=lambda k: (n[k], k), default=0)
    good = sorted((r for r in good if len(r[2]) == d), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cuts = [(j * d // parts, (j + 1) * d // parts) for j in range(parts)]
    whole = [[math.floor(Fraction(x) * scale) for x in v] for _, _, v in good]
    split = [[v[a:b] for v in whole] for a, b in cuts]
    books = [m[:entries] for m in split]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    best = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for m, book in zip(split, books):
            of = [best(x, book)[1] for x in m]
            for e in range(len(book)):
                mine = [x for x, y in zip(m, of) if y == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[best(m[i], book) for m, book in zip(split, books)] for i in range(len(good))]
    errors = [sum(f for f, _ in row) for row in found]
    by_label = Counter()
    for (_, label, _), e in zip(good, errors):
        by_label[label] += e
    fits = lambda e: e if e < 2**63 else None
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return Counter((i, label, "".join(f"{e:02x}" for _, e in row), fits(err), fits(by_label[label]), sha) for (i, label, _), row, err in zip(good, found, errors))


VECTORS = "vec_id long, embedding array<double>, label int, code string, _row int, error string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, "e") for i, label, v in rows], VECTORS)


def check(spark, rows, parts, entries, rounds):
    got, _ = lloyd.vector_codes(vectors(spark, rows).repartition(3), parts=parts, entries=entries, rounds=rounds)
    assert multiset(got.collect()) == codes_of(rows, parts, entries, rounds)


@pytest.mark.parametrize("small", [False, True])
def test_vector_codes_equal_plain_lloyd(spark, monkeypatch, small):
    """With small owners, entries are many salts and members move between partitions."""
    if small:
        monkeypatch.setattr(lloyd, "OWNER_PARTS", 64)
        monkeypatch.setattr(lloyd, "BLOCK_PARTS", 8)
    rng = random.Random(7)
    rows = [(rng.randrange(5000), rng.choice([None, 0, 1, 2]), [rng.gauss(rng.choice([-1, 0, 2]), 0.3) for _ in range(12)]) for _ in range(300)]
    rows += [(9000 + i, 7, [0.25] * 12) for i in range(200)]  # one entry with many equal members
    rows += [(1, 1, None), (2, 1, [None] * 12), (3, 1, [float("nan")] * 12), (4, 1, [float("inf")] * 12), (None, 1, [0.5] * 12), (None, None, [-0.5] * 12), (5, 1, [0.1]), (6, 1, [])]
    check(spark, rows, parts=4, entries=16, rounds=6)


def test_vector_codes_of_odd_tables(spark):
    few = [(i, None, [0.1 * i, -1.0 * i, 3.0]) for i in range(5)]
    check(spark, few, parts=8, entries=16, rounds=2)  # parts without components, fewer rows than entries
    check(spark, [(1, 0, []), (2, None, [])], parts=8, entries=16, rounds=1)
    large = [(i, i % 2, [1e9 * i, -1e300 if i == 7 else 1.5, 5e6, 1e-300]) for i in range(20)]
    check(spark, large, parts=2, entries=4, rounds=3)
    check(spark, few + [(9, 1, [1.0, 2.0])] * 3, parts=3, entries=2, rounds=6)
    check(spark, [], parts=8, entries=16, rounds=6)


def test_only_moved_members_are_shuffled(spark):
    rng = random.Random(3)
    df = vectors(spark, [(i, 0, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)])
    rows, n, d, top = lloyd.members_of(df, "vec_id", "embedding", "label")
    books = [lloyd.integers(lloyd.np.array([[rng.gauss(0, 1)] for _ in range(4)]), 4096, False).astype(object) for _ in range(8)]
    owners = lloyd.Owners(8, 4, 1, 8)
    residents = lloyd.first_blocks(rows, d, 4096, False, books, owners).partitionBy(8, lloyd.home)
    again = lloyd.migrated(residents, books, owners, [])
    at = lambda rdd: sorted((p, o, int(r)) for p, part in enumerate(rdd.glom().collect()) for o, (rs, _) in part for r in rs)
    assert at(again) == at(residents) and len(at(again)) == 8 * n and again.getNumPartitions() == 8
    keep = []
    other = [b[::-1].copy() for b in books]
    moved = lloyd.migrated(residents, other, owners, keep)
    assert all(lloyd.home(o) % 8 == p for p, o, _ in at(moved))
    leaving = keep[0].flatMap(lambda x: [] if x[0] else list(x[1][1][0])).count()
    changed = len({(o, r) for _, o, r in at(moved)} - {(o, r) for _, o, r in at(residents)})
    assert 0 < leaving <= changed <= 8 * n
