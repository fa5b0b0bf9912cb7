"""SimHash near-duplicates: deletion-variant signatures, equality join, verified links, components.

A fingerprint is cut into segments, few enough that of two linked fingerprints
one segment differs by at most one bit. Each segment is indexed once for each of
its bits, with that bit taken out: segments that differ in that bit only, or not
at all, get the same entry. Entries meet by equality and are verified on the
whole fingerprint.

With ``bits`` = 64, segments of 32 bits and links at 2 differing bits this finds
every link: 2 bits over 2 segments leave one with 1 at most. For looser links
than ``2 * segments - 1`` bits the index finds a link with a probability that is
measured in the tests.

``first_of_groups`` verifies such links by the Jaccard similarity of shingles itself; what
the fingerprints cannot find meets by the shingles of set prefixes, which no similar pair can miss.
Pairs meet first by a bit for each shingle, which rules out most of them; whole sets only for the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.llm.common import Words, byte_texts, chunks, components, discard, lower_ascii, mixed, numbered, release, slices, written

SEED = 42
SMALL_RUN = 16  # entries of a key compared by shifted arrays, all pairs
SAMPLE_ROWS = 8192  # texts that show which shingles are common; this steers speed only
COMMON = 1 << 17  # common shingles that a task holds
PASSES = 4  # parts of the pairs whose sets travel one after another, and of the entries
LARGE_RUN = 4096  # beyond it a key is split once more by further deletion variants

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All shingles in order, repeats included; fewer words give one, none give none."""
    if not words:
        return []
    text = b" ".join(words)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    size = min(size, len(words))
    return [text[a:b] for a, b in zip(start[: len(words) - size + 1].tolist(), end[size - 1:].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the 64-bit hashes set."""
    n = len(hashes)
    if n == 0:
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if n < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int, parts: int) -> list[int]:
    found = shingles(text.lower().split(), shingle)
    return [majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED + p) for s in found), dtype=np.uint64, count=len(found))) for p in range(parts)]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def fingerprints(df: DataFrame, shingle: int, parts: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, f0, f1, ...): a fingerprint of 64 bits for each part, one row per row of ``df``."""
    kind = dict(df.dtypes)[id_column]

    def scan(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle, parts) for t in byte_texts(batch.column(1))], dtype=np.uint64).reshape(-1, parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[_signed(np.ascontiguousarray(values[:, p])) for p in range(parts)]], names=["_id", *[f"f{p}" for p in range(parts)]])

    return df.select(id_column, text_column).mapInArrow(scan, f"_id {kind}, " + ", ".join(f"f{p} long" for p in range(parts)))


def hexadecimal(parts: int) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"f{p}"), 16, "0") for p in range(parts)]))


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1) <= distance


def _spanning(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that hold together all linked entries of one key: a search from each entry not yet reached."""
    rest, out = np.arange(len(values)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _near(values[rest], values[at], distance)
            out += [(at, int(x)) for x in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return out


def _split(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """As ``_spanning``, for a long run of 64-bit entries linked at 3 bits or fewer. The
    entries agree on one segment but for a bit; of the other segment's two halves
    one differs by at most one bit, so the run is indexed again by these halves."""
    halves = [low for low in range(0, 64, 16) if len(np.unique(values[:, 0] & np.uint64(0xFFFF << low))) > 2]
    if len(halves) < 2:
        return _spanning(values, distance)
    found = set()
    for low in halves:
        for bit in range(low, low + 16):
            key = values[:, 0] & np.uint64((0xFFFF << low) & ~(1 << bit))
            order = np.argsort(key, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(run) > 1:
                    found.update((int(run[a]), int(run[b])) for a, b in _spanning(values[run], distance))
    return list(found)


def links(classes: DataFrame, parts: int, segment: int, distance: int) -> DataFrame:
    """Pairs (a, b) of hexadecimal fingerprints that hold all links of ``classes`` together.

    ``classes`` has each fingerprint once. The rows of a key are read in order
    by one task as they come; a key needs 8 bytes a part for each of its distinct
    fingerprints, and gives fewer links than it has rows.
    """
    columns = [f"f{p}" for p in range(parts)]
    per_part = 64 // segment

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                values = [np.asarray(piece.column(p)).view(np.uint64) for p in range(parts)]
                for p in range(parts):
                    keys = []
                    for s in range(per_part):
                        part = values[p] & np.uint64(((1 << segment) - 1) << (s * segment))
                        for bit in range(s * segment, (s + 1) * segment):
                            keys.append(mixed((part & ~np.uint64(1 << bit)) ^ mixed(np.full(1, p * 64 + bit + 1, dtype=np.uint64))))
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), *[_signed(np.tile(v, len(keys))) for v in values]], names=["key", *columns])

    def verify(batches):
        key, values = np.zeros(0, np.int64), np.zeros((0, parts), np.uint64)

        def pairs(key, values):
            """Of whole runs; ``key`` is in order."""
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(start, len(key)))
            left = np.repeat(start + length, length) - np.arange(len(key))  # rows of the run from here on
            size = np.repeat(length, length)
            a, b = [], []
            for shift in range(1, SMALL_RUN):
                i = np.flatnonzero((left > shift) & (size <= SMALL_RUN))
                if not len(i):
                    break
                i = i[_near(values[i], values[i + shift], distance)]
                a.append(i), b.append(i + shift)
            for s, n in zip(start[length > SMALL_RUN], length[length > SMALL_RUN], strict=True):
                run = values[s:s + n]
                got = _split(run, distance) if n > LARGE_RUN and parts == 1 and distance <= 3 else _spanning(run, distance)
                if got:
                    x, y = np.array(got).T
                    a.append(s + x), b.append(s + y)
            if not a:
                return None
            both = np.concatenate([values[np.concatenate(a)], values[np.concatenate(b)]], axis=1)
            both = np.unique(both, axis=0) if len(both) else both
            return pa.RecordBatch.from_arrays([_signed(np.ascontiguousarray(both[:, c])) for c in range(2 * parts)], names=[f"{x}{p}" for x in "ab" for p in range(parts)])

        for batch in batches:
            key = np.concatenate([key, np.asarray(batch.column(0))])
            values = np.concatenate([values, np.stack([np.asarray(batch.column(1 + p)).view(np.uint64) for p in range(parts)], axis=1)])
            if not len(key):
                continue
            done = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if done:
                if (out := pairs(key[:done], values[:done])) is not None:
                    yield out
                key, values = key[done:], values[done:]
        if len(key) and (out := pairs(key, values)) is not None:
            yield out

    keyed = classes.select(*columns).mapInArrow(index, "key long, " + ", ".join(f"{c} long" for c in columns))
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, ", ".join(f"{x}{p} long" for x in "ab" for p in range(parts)))
    name = lambda x: F.lower(F.concat(*[F.lpad(F.hex(f"{x}{p}"), 16, "0") for p in range(parts)]))
    return met.select(name("a").alias("a"), name("b").alias("b")).distinct()


def class_components(prints: DataFrame, parts: int, segment: int, distance: int) -> DataFrame:
    """(f0, f1, ..., node, component) of each distinct fingerprint of ``prints``; node and
    component are hexadecimal, a fingerprint without links is its own component."""
    columns = [f"f{p}" for p in range(parts)]
    classes = written(prints.select(*columns).distinct().withColumn("node", hexadecimal(parts)), "classes")
    joined = components(links(classes, parts, segment, distance))
    return classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(
    df: DataFrame, shingle: int = 5, parts: int = 1, segment: int = 32, distance: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``df``.

    Texts are lower-cased (A-Z), words are ``[^\\x20\\x09-\\x0D]+``. Equal
    fingerprints fold before anything is indexed, so copies cost nothing, and
    the component is the smallest id reachable over links, the row's own
    included. Null and empty texts have the fingerprint zero and are linked like
    any other. A null id takes part but is never the smallest id; a component of
    null ids only has a null component. Repeated ids and rows keep their rows.
    Other columns are not read. An empty table gives an empty result.
    """
    prints = written(fingerprints(df, shingle, parts, id_column, text_column), "fingerprints")
    columns = [f"f{p}" for p in range(parts)]
    of_class = written(class_components(prints, parts, segment, distance).join(prints.groupBy(*columns).agg(F.min("_id").alias("least")), columns), "components")
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    found = of_class.join(least, "component").select(*columns, F.col("node").alias("fingerprint"), "component_id")
    return prints.join(found, columns).select(F.col("_id").alias(id_column), "fingerprint", "component_id")


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text in order; fewer words give one shingle, none give none."""
    for a, b in chunks(texts):
        words = Words([lower_ascii(t) for t in texts[a:b]])
        whole, _ = words.grams(size)
        for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if hi - lo >= size:
                yield np.unique(whole[lo:hi - size + 1])
            elif hi > lo:
                yield np.frombuffer(xxhash.xxh64(words.hash[lo:hi].tobytes(), SEED).digest(), dtype=np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def prefix(found: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """So many shingles, rare ones first, that each set of this Jaccard similarity or more
    has one of them among its own. Any one order of all shingles will do for that;
    ``common`` (in order) and their counts ``often`` only keep the entries of a shingle few."""
    if not len(found):
        return found
    rank = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, often[at], 0)
    return found[np.argsort(rank, kind="stable")[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]]


def parities(found: np.ndarray) -> np.ndarray:
    """A bit for each shingle or more, a power of two of them: whether an odd number of shingles falls on it."""
    size = max(64, 1 << max(len(found) - 1, 0).bit_length())
    ones = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view(np.uint64)


def apart_at_least(p: np.ndarray, q: np.ndarray) -> int:
    """A bound on the shingles that one of two sets has and the other lacks: each bit
    in which their ``parities`` differ takes one at least. The longer is folded to the shorter."""
    size = min(len(p), len(q))
    p, q = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (p, q))
    return int(np.bitwise_count(p ^ q).sum())


def possible_pairs(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, x, y: nodes and sizes) that ``parities`` leave; no pair of this similarity is lost."""
    share = (1 - similarity) / (1 + similarity)  # of both sizes, the most that such sets can differ in

    def scan(batches):
        for batch in slices(batches):
            a, b, x, y, p, q = (batch.column(c) for c in ("a", "b", "x", "y", "p", "q"))
            most = share * (np.asarray(x).astype(np.int64) + np.asarray(y)) + 1e-6
            left = np.fromiter((apart_at_least(np.asarray(u.values).view(np.uint64), np.asarray(v.values).view(np.uint64)) for u, v in zip(p, q, strict=True)), dtype=np.int64, count=len(most))
            left = pa.array(left <= most)
            yield pa.RecordBatch.from_arrays([a.filter(left), b.filter(left)], names=["a", "b"])

    near = pairs.where(F.least("x", "y") >= F.greatest("x", "y") * similarity - 1e-9).distinct()
    both = near.join(classes.select(F.col("node").alias("a"), F.col("bits").alias("p")), "a").join(classes.select(F.col("node").alias("b"), F.col("bits").alias("q")), "b")
    return both.select("a", "b", "x", "y", "p", "q").mapInArrow(scan, "a long, b long")


def common_shingles(keys: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of ``SAMPLE_ROWS`` distinct texts share, in order, and in how many."""

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([s.view(np.int64) for s in shingle_sets(byte_texts(batch.column(0)), shingle)], type=pa.list_(pa.int64()))], names=["found"])

    sample = keys.where(F.rand(SEED) < SAMPLE_ROWS / max(keys.count(), 1)).select("_text")
    each = sample.mapInArrow(scan, "found array<long>").distinct().select(F.explode("found").alias("s"))
    top = each.groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    common, often = np.asarray(top.column(0)).astype(np.int64).view(np.uint64), np.asarray(top.column(1)).astype(np.int64)
    order = np.argsort(common)
    return common[order], often[order]


def fingerprint_pairs(nodes: DataFrame, segment: int = 32, distance: int = 2) -> DataFrame:
    """(a, b): pairs of nodes that hold all nodes of linked fingerprints together; ``nodes`` is (node, f0)."""
    least = written(nodes.groupBy("f0").agg(F.min("node").alias("least")), "fingerprints")
    equal = nodes.join(least, "f0").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    named = least.select(hexadecimal(1).alias("print"), "least")
    met = links(least.select("f0"), 1, segment, distance)
    met = met.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
    return equal.union(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def similar_links(heads: DataFrame, classes: DataFrame, keys: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that hold all pairs of this Jaccard similarity or more together.

    ``heads`` (node, size, heads): the prefix of each set, deleted when it is read; ``classes``
    (node, f0, bits): fingerprints and ``parities``; ``keys`` (_row, _text):
    the texts of the nodes. Nodes whose SimHash fingerprints link are held against each
    other first. For the pairs that this cannot find, each entry of a key is first held against the key's
    least node, if they are not together yet, so that a large group of copies joins at
    once; then all pairs of a key that are still apart are. Every pair is linked by its whole sets.
    """
    by = Window.partitionBy("key")
    entries, shared = heads.select(F.explode("heads").alias("key"), "node", "size"), None
    for k in range(PASSES):  # a part of the entries is on disk at a time
        met = entries.where(F.pmod(F.xxhash64("key"), F.lit(PASSES)) == k)
        met = met.withColumn("least", F.min(F.struct("node", "size")).over(by)).withColumn("most", F.max("node").over(by))
        part = written(met.where("least.node < most").drop("most"), "shared")
        shared = part if shared is None else shared.union(part)
        release(part.sparkSession)
    discard(heads)

    def scan(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(byte_texts(batch.column(1)), shingle)], type=pa.list_(pa.int64()))], names=["node", "found"]
            )

    def verified(pairs: DataFrame) -> DataFrame:
        """All pairs that are possible are held against whole sets; in passes, so that a part of the sets is on disk at a time."""
        near = written(possible_pairs(pairs, classes, similarity), "near")
        release(near.sparkSession)
        wanted = written(near.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), "nodes")
        sets = written(keys.select("_row", "_text").join(wanted, "_row", "left_semi").mapInArrow(scan, "node long, found array<long>"), "sets")
        discard(wanted)  # and the texts' shuffle
        links = None
        for k in range(PASSES):
            mine = F.pmod(F.xxhash64("a"), F.lit(PASSES)) == k
            both = near.where(mine).join(sets.select(F.col("node").alias("a"), F.col("found").alias("p")).where(mine), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("q")), "b")
            both = both.select("a", "b", F.size(F.array_intersect("p", "q")).alias("n"), (F.size("p") + F.size("q")).alias("m"))
            part = written(both.where(F.col("n") / (F.col("m") - F.col("n")) >= similarity).select("a", "b"), "links")
            links = part if links is None else links.union(part)
            release(near.sparkSession)  # the sets' shuffles
        discard(near, sets)
        return links

    of_size = written(shared.select("node", "size").distinct(), "sizes")
    likely = fingerprint_pairs(classes.select("node", "f0").join(of_size, "node", "left_semi"))
    likely = likely.join(of_size.toDF("a", "x"), "a").join(of_size.toDF("b", "y"), "b")
    printed = verified(likely)
    together = written(components(printed), "together")
    hub = F.col("least.node")
    held = shared.where("least.node < node").join(together, "node", "left").join(together.toDF("_hub", "_of_hub"), hub == F.col("_hub"), "left")
    held = held.where(F.coalesce("component", "node") != F.coalesce("_of_hub", hub))
    first = printed.union(verified(held.select(hub.alias("a"), F.col("node").alias("b"), F.col("least.size").alias("x"), F.col("size").alias("y"))))
    placed = shared.drop("least").join(components(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = placed.withColumn("low", F.min("component").over(by)).withColumn("high", F.max("component").over(by)).where("low < high")
    apart = written(apart.select("key", "node", "size", "component"), "apart")
    discard(shared)
    one = apart.select("key", F.col("node").alias("a"), F.col("size").alias("x"), F.col("component").alias("c"))
    two = apart.select("key", F.col("node").alias("b"), F.col("size").alias("y"), F.col("component").alias("d"))
    second = verified(one.join(two, "key").where("a < b and c <> d"))
    discard(apart)
    return first.union(second)


def first_of_groups(df: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row with the smallest id of each group of near-duplicates, with all its columns.

    Texts are linked if the Jaccard similarity of their sets of shingles (64-bit
    hashes of them) is ``similarity`` or more, all such pairs and no others; a
    group is all that links reach. Equal sets fold before anything is indexed.
    Null ids come last; of equal ids the row that is read first stays. Empty and
    null texts are copies of each other.
    """
    plain_names = [f"c{i}" for i in range(len(df.columns))]  # whatever the columns are called
    rows = numbered(df.toDF(*plain_names), *plain_names)
    order, text = (plain_names[df.columns.index(c)] for c in (id_column, text_column))
    keys = rows.select("_row", F.col(order).alias("_order"), F.col(text).alias("_text"))
    common, often = common_shingles(keys, shingle)
    sent = df.sparkSession.sparkContext.broadcast((common, often))  # 2 MB at most

    def scan(batches):
        common, often = sent.value
        for batch in slices(batches):
            texts = byte_texts(batch.column(2))
            digest, size, heads, bits = [], [], [], []
            for s in shingle_sets(texts, shingle):
                digest.append(xxhash.xxh3_128_digest(s.tobytes())), size.append(len(s))
                heads.append(prefix(s, similarity, common, often).view(np.int64)), bits.append(parities(s).view(np.int64))
            f0 = np.array([fingerprint(t, shingle, 1)[0] for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(digest, type=pa.binary()), pa.array(size, type=pa.int32()), _signed(f0),
                    pa.array(heads, type=pa.list_(pa.int64())), pa.array(bits, type=pa.list_(pa.int64())),
                ],
                names=["_row", "_order", "digest", "size", "f0", "heads", "bits"],
            )

    found = keys.mapInArrow(scan, f"_row long, _order {dict(keys.dtypes)['_order']}, digest binary, size int, f0 long, heads array<long>, bits array<long>")
    least = F.min(F.struct(F.col("_order").isNull().alias("a"), F.col("_order").alias("b"), F.col("_row").alias("c"))).alias("least")
    own = F.min(F.struct("_row", "f0")).alias("own")
    whole = written(found.groupBy("digest").agg(least, own, *[F.first(c).alias(c) for c in ("size", "heads", "bits")]).drop("digest"), "heads")
    release(df.sparkSession)
    whole = whole.withColumn("node", F.col("own._row"))
    classes = written(whole.select("node", "least", F.col("own.f0").alias("f0"), "bits"), "classes")
    joined = components(similar_links(whole.select("node", "size", "heads"), classes, keys, shingle, similarity))
    first = classes.select("node", "least").join(joined, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("least").alias("first"))
    kept = written(first.select(F.col("first.c").alias("_row")), "kept")
    return rows.join(kept, "_row", "left_semi").drop("_row").toDF(*df.columns)
