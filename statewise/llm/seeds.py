"""Benchmark decontamination by spaced seeds.

A mask fixes which of ``span`` consecutive words a seed reads; the others may
differ. Seeds of the test items and of the documents meet by their hashes, and
each hit fixes an alignment (a diagonal) of item and document. An alignment is
verified word by word: it counts if long enough a stretch of the item agrees, up
to a share of substituted words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.llm.common import Words, byte_texts, chunks, lower_ascii, mixed, numbered

# Words that a seed reads (1) or ignores (0). Each mask ignores other places, so a
# substituted word that spoils one leaves another.
MASKS = ("1101100101", "1110010111", "1011101", "11011")
MIN_SHARE = 0.5  # of the item's words, aligned and equal
MIN_EQUAL = 8  # equal words of an alignment, or the whole item if it is shorter
MAX_SUBSTITUTED = 0.3  # share of unequal words inside the aligned stretch
CHUNK_WORDS = 1 << 20  # words of test items that a task holds at once


def _seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, hash_of_mask(mask), dtype=np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    return mixed(out)


def hash_of_mask(mask: str) -> int:
    return int(mask, 2) * 0x5851F42D4C957F2D % (1 << 64)


class Items:
    """Test items of one chunk: words, seeds in order of their hash, and a bitmap of the hashes."""

    BITMAP = 24  # bits of a hash that index the bitmap: 16 MB of bytes at most

    def __init__(self, ids: list, texts: list[bytes], masks: tuple[str, ...]):
        keep = [i for i, t in enumerate(texts) if len(t.split()) >= min(map(len, masks))]
        self.ids = [ids[i] for i in keep]
        self.words = Words([lower_ascii(texts[i]) for i in keep])
        self.size = np.diff(self.words.first)
        hashes, place = [], []
        self.masks = masks
        for mask in masks:
            h = _seed_hashes(self.words.hash, mask)
            at = np.arange(len(h))
            at = at[self.words.text[at] == self.words.text[at + len(mask) - 1]]
            hashes.append(h[at]), place.append(at)
        hashes, place = np.concatenate(hashes), np.concatenate(place)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.place = hashes[order], place[order]
        self.bitmap = np.zeros(1 << self.BITMAP, dtype=bool)
        self.bitmap[self.hashes >> np.uint64(64 - self.BITMAP)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(document word, item word) of all seeds that agree."""
        docs, items = [], []
        for mask in self.masks:
            h = _seed_hashes(words.hash, mask)
            at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - self.BITMAP)])
            at = at[words.text[at] == words.text[at + len(mask) - 1]]
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            n = hi - lo
            docs.append(np.repeat(at, n))
            items.append(self.place[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(docs), np.concatenate(items)

    def overlaps(self, words: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, equal words, first word in the text, end) of each verified alignment."""
        d, i = self.hits(words)
        if not len(d):
            return
        text, item = words.text[d], self.words.text[i]
        shift = d - i  # document word that meets item word 0 of the chunk
        for t, e, s in sorted(set(zip(text.tolist(), item.tolist(), shift.tolist(), strict=True))):
            a, b = int(self.words.first[e]), int(self.words.first[e + 1])
            lo = max(a, int(words.first[t]) - s)
            hi = min(b, int(words.first[t + 1]) - s)
            same = self.words.hash[lo:hi] == words.hash[lo + s:hi + s]
            found = stretch(same)
            if found is None:
                continue
            x, y, equal = found
            need = min(b - a, max(MIN_EQUAL, int(np.ceil(MIN_SHARE * (b - a)))))
            if equal >= need:
                yield t, e, equal, lo + s + x - int(words.first[t]), lo + s + y - int(words.first[t])


def stretch(same: np.ndarray) -> tuple[int, int, int] | None:
    """The stretch of an alignment with the greatest excess of equal over unequal words,
    where an unequal word weighs what ``MAX_SUBSTITUTED`` allows: (begin, end, equal words)."""
    gain = np.where(same, MAX_SUBSTITUTED, MAX_SUBSTITUTED - 1.0)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    best = total - np.minimum.accumulate(total)
    end = int(np.argmax(best))
    if end == 0:
        return None
    begin = int(np.argmin(total[: end + 1]))
    return begin, end, int(same[begin:end].sum())


def item_chunks(items: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list, list[bytes]]]:
    """Test items in chunks of ``CHUNK_WORDS`` words, read one after another."""
    ids, texts, held = [], [], 0
    for row in items.select(id_column, text_column).toLocalIterator(prefetchPartitions=False):
        text = (row[1] or "").encode()
        ids.append(row[0]), texts.append(text)
        held += text.count(b" ") + 1
        if held >= CHUNK_WORDS:
            yield ids, texts
            ids, texts, held = [], [], 0
    yield ids, texts


def contamination(
    documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, n_overlaps, items, equal_words, spans, contaminated): one row per row of ``documents``.

    ``items`` lists the ids of items with a verified overlap in order, ``spans``
    the words ``item:first:end`` of the overlaps, ``equal_words`` the largest number
    of equal words. A task holds one chunk of items of a fixed size; further
    chunks are further passes, so any number of items gives whole results, and
    documents never move. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing
    A-Z. Null or empty texts overlap with nothing, nor do items of fewer words than
    the shortest mask, which say too little; an item with a null id is reported as null. Repeated rows keep their rows; without items nothing
    is contaminated; other columns are not read.
    """
    rows = numbered(documents, id_column, text_column)
    kind, item_kind = dict(documents.dtypes)[id_column], dict(items.dtypes)[item_column]
    schema = f"_row long, _id {kind}, overlaps array<struct<item:{item_kind},equal:int,first:int,end:int>>"
    found = None
    for ids, texts in item_chunks(items, item_column, item_text):

        def scan(batches, ids=ids, texts=texts):
            chunk = Items(ids, texts, masks)
            for batch in batches:
                bodies, out = [lower_ascii(t) for t in byte_texts(batch.column(2))], [[] for _ in range(batch.num_rows)]
                if chunk.ids:
                    for a, b in chunks(bodies):
                        for t, e, equal, first, end in chunk.overlaps(Words(bodies[a:b])):
                            out[a + t].append({"item": chunk.ids[e], "equal": equal, "first": first, "end": end})
                arrow = pa.list_(pa.struct([("item", item_type), ("equal", pa.int32()), ("first", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=arrow)], names=["_row", "_id", "overlaps"])

        item_type = items.select(item_column).limit(0).toArrow().schema.field(0).type
        part = rows.mapInArrow(scan, schema)
        found = part if found is None else found.union(part).groupBy("_row", "_id").agg(F.flatten(F.collect_list("overlaps")).alias("overlaps"))
    spans = F.array_join(F.transform("overlaps", lambda o: F.concat_ws(":", F.coalesce(o["item"].cast("string"), F.lit("null")), o["first"].cast("string"), o["end"].cast("string"))), ",")
    return found.withColumn("overlaps", F.array_sort("overlaps")).select(
        F.col("_id").alias(id_column),
        F.size("overlaps").cast("long").alias("n_overlaps"),
        F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o["item"]))).alias("items"),
        F.coalesce(F.array_max(F.transform("overlaps", lambda o: o["equal"])), F.lit(0)).alias("equal_words"),
        spans.alias("spans"),
        (F.size("overlaps") > 0).alias("contaminated"),
    )


def clean_rows(documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``documents`` without a verified overlap, with all their columns as they are.

    Null and empty texts stay. Rows that one chunk of items clears go on to the next.
    """
    place = documents.columns.index(text_column)
    for ids, texts in item_chunks(items, item_column, item_text):

        def scan(batches, ids=ids, texts=texts):
            chunk = Items(ids, texts, masks)
            for batch in batches:
                bodies = [lower_ascii(t) for t in byte_texts(batch.column(place))]
                clean = np.ones(batch.num_rows, dtype=bool)
                if chunk.ids:
                    for a, b in chunks(bodies):
                        for t, *_ in chunk.overlaps(Words(bodies[a:b])):
                            clean[a + t] = False
                yield batch.filter(pa.array(clean))

        documents = documents.mapInArrow(scan, documents.schema)
    return documents
