"""Removal of repeated passages with sharded Aho-Corasick automata.

1. Phrases. Of the short phrases in each window of words the one with the least
   hash stands for the window, so equal windows have equal phrases. Phrases are
   counted over all documents; those that occur once rule their windows out.
2. Automata. Documents are dealt into blocks. The automaton of a block holds the
   recurring phrases that the block's documents have, wherever else they occur,
   so its size is bounded by the block, and a phrase that is everywhere is one
   pattern in each. All documents of the block are streamed through it; windows
   whose phrase is located are kept as passages.
3. Earliest. Equal passages fold to the earliest; windows of different passages
   meet by a 96-bit hash, and all but the earliest of each are removed.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewise.llm.common import Words, byte_texts, chunks, mixed, numbered, release, written

PHRASE = 6  # words of a phrase
BLOCK_BITS = 10  # a block has at most 2**10 consecutive rows
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (np.minimum or np.maximum) over all ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    step, out = 1, values
    while step * 2 <= width:
        out = of(out[:-step], out[step:])
        step *= 2
    return of(out[:n], out[width - step:width - step + n])


class Windows:
    """Windows of ``size`` words in some texts, and the phrases that stand for them."""

    def __init__(self, texts: list[bytes], size: int):
        self.words = Words(texts)
        self.size, self.phrase = size, min(PHRASE, size)
        self.width = size - self.phrase + 1  # phrases in a window
        self.hash, _ = self.words.grams(self.phrase)
        n = len(self.words) - size + 1
        self.inside = self.words.text[:n] == self.words.text[size - 1:] if n > 0 else np.zeros(0, bool)
        self.least = sliding(self.hash, self.width, np.minimum)

    def chosen(self) -> np.ndarray:
        """First words of the phrases that stand for a window."""
        if not self.inside.any():
            return np.zeros(0, np.int64)
        pad = np.zeros(self.width - 1, np.uint64)
        best = sliding(np.concatenate([pad, np.where(self.inside, self.least, 0), pad]), self.width, np.maximum)
        return np.flatnonzero((best == self.hash) & (best > 0))

    def passages(self, located: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first word in the text, windows) of runs of windows whose phrase is at a ``located`` word."""
        if not len(located) or not self.inside.any():
            return []
        hits = np.full(len(self.hash), _MOST, dtype=np.uint64)
        hits[located] = self.hash[located]
        good = self.inside & (sliding(hits, self.width, np.minimum) == self.least) & (self.least != _MOST)
        edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            at = np.flatnonzero(np.diff(self.words.text[a:b])) + 1 + a  # a run may reach into the next text
            for x, y in zip([a, *at.tolist()], [*at.tolist(), b], strict=True):
                t = int(self.words.text[x])
                out.append((t, x - int(self.words.first[t]), y - x))
        return out


def _joined(buffer: bytes, start: int, end: int) -> bytes:
    return b" ".join(buffer[start:end].split())


def block_phrases(rows: DataFrame, size: int) -> DataFrame:
    """(block, phrase, n): standing phrases of each block."""

    def scan(batches):
        held: dict[tuple[int, bytes], int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], type=pa.int64()), pa.array([p for _, p in held], type=pa.binary()), pa.array(list(held.values()), type=pa.int64())], names=["block", "phrase", "n"])
            held.clear()
            return out

        for batch in batches:
            texts = byte_texts(batch.column(1))
            block = batch.column(0).to_numpy() >> BLOCK_BITS
            for a, b in chunks(texts):
                w = Windows(texts[a:b], size)
                at = w.chosen()
                first, last = w.words.start[at].tolist(), w.words.end[at + w.phrase - 1].tolist()
                for x, y, k in zip(first, last, block[a + w.words.text[at]].tolist(), strict=True):
                    key = (k, _joined(w.words.buffer, x, y))
                    held[key] = held.get(key, 0) + 1
                if len(held) > 100_000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(scan, "block long, phrase binary, n long")


class Automaton:
    """Phrases of a block; locates them in texts of words parted by one space."""

    def __init__(self):
        self.machine = ahocorasick.Automaton()

    def add(self, phrase: bytes) -> None:
        text = f" {phrase.decode('latin-1')} "
        self.machine.add_word(text, len(text))

    def located(self, words: Words, texts: int) -> np.ndarray:
        """First words of all occurrences."""
        if not len(words) or not len(self.machine):
            return np.zeros(0, np.int64)
        if self.machine.kind != ahocorasick.AHOCORASICK:
            self.machine.make_automaton()
        spelled = [words.buffer[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        cut = words.first.tolist()
        line = b"".join(b" " + b"".join(w + b" " for w in spelled[a:b]) + b"\n" for a, b in zip(cut[:-1], cut[1:], strict=True))
        length = words.end - words.start + 1
        place = np.cumsum(length) - length + 2 * words.text + 1  # of each word in ``line``
        found = [end - size + 2 for end, size in self.machine.iter(line.decode("latin-1"))]
        return np.unique(np.searchsorted(place, np.array(found, dtype=np.int64)))


def locate(rows: DataFrame, recurring: DataFrame, size: int) -> DataFrame:
    """(_row, first, text): passages of all documents, found by the automata of their blocks."""
    kinds = "block long, ord int, _row long, body binary"
    patterns = recurring.select("block", F.lit(0).alias("ord"), F.lit(0).cast("long").alias("_row"), F.col("phrase").alias("body"))
    documents = rows.select(F.shiftright("_row", BLOCK_BITS).alias("block"), F.lit(1).alias("ord"), "_row", F.col("_text").cast("binary").alias("body"))
    dealt = patterns.union(documents).repartition("block").sortWithinPartitions("block", "ord", "_row").select(*[x.split()[0] for x in kinds.split(", ")])

    def stream(batches):
        block, machine, held, held_rows, weight = None, None, [], [], 0

        def out():
            w = Windows(held, size)
            row, first, text = [], [], []
            for t, a, n in w.passages(machine.located(w.words, len(held))):
                at = int(w.words.first[t]) + a
                row.append(held_rows[t]), first.append(a)
                text.append(_joined(w.words.buffer, int(w.words.start[at]), int(w.words.end[at + n + size - 2])))
            held.clear(), held_rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(row, type=pa.int64()), pa.array(first, type=pa.int32()), pa.array(text, type=pa.binary())], names=["_row", "first", "text"])

        for batch in batches:
            for b, ord_, r, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != block or weight > 1 << 20:
                    if held:
                        yield out()
                    weight = 0
                    if b != block:
                        block, machine = b, Automaton()
                if ord_ == 0:
                    machine.add(body)
                elif len(machine.machine) and body:
                    held.append(body), held_rows.append(r)
                    weight += len(body)
        if held:
            yield out()

    return dealt.mapInArrow(stream, "_row long, first int, text binary")


PART = 40  # bits of a place that count windows inside a part


def ordered(passages: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Passages with ``base``: places of their windows, unique, in order of id, row and start."""
    keyed = passages.join(ids, "_row")
    ranged = keyed.repartitionByRange(F.col("_id").isNull(), "_id", "_row", "first").sortWithinPartitions(F.col("_id").isNull(), "_id", "_row", "first")
    counted = ranged.select(F.shiftright(F.monotonically_increasing_id(), 33).alias("part"), "_row", "first", "text")

    def place(batches):
        total = 0
        for batch in batches:
            n = np.array([t.count(b" ") + 1 for t in batch.column(3).to_pylist()], dtype=np.int64)
            base = (batch.column(0).to_numpy() << PART) + total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(base), batch.column(1), batch.column(2), pa.array(n), batch.column(3)], names=["base", "_row", "first", "n", "text"])

    return counted.mapInArrow(place, "base long, _row long, first int, n long, text binary").withColumn("key", F.md5("text"))


def window_rows(passages: DataFrame, size: int) -> DataFrame:
    """(w1, w2, place, later): two hashes of each window of the passages.

    ``later``: the window also stands earlier in the same batch of rows. Only the
    others need to meet, so a window that is everywhere has one row for each batch.
    """

    def scan(batches):
        for batch in batches:
            base, texts, found = batch.column(0).to_numpy(), byte_texts(batch.column(1)), []
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                h, inside = w.grams(size)
                at = np.flatnonzero(inside)
                place = base[a + w.text[at]] + at - w.first[w.text[at]]
                second = np.zeros(len(h), np.uint64)
                for j in range(size):
                    second = second * np.uint64(0xD1342543DE82EF95) + mixed(w.hash[j:j + len(h)])
                found.append((h[at].view(np.int64), (mixed(second[at]) >> np.uint64(32)).astype(np.uint32).view(np.int32), place))
            if not found:
                continue
            w1, w2, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((place, w2, w1))
            same = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
            later = np.zeros(len(place), dtype=bool)
            later[order[1:][same]] = True
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(place), pa.array(later)], names=["w1", "w2", "place", "later"])

    return passages.select("base", "text").mapInArrow(scan, "w1 long, w2 int, place long, later boolean")


def spans(passages: DataFrame, later: DataFrame, size: int) -> DataFrame:
    """(_row, first, end): removed words of the passages, from the places of removed windows."""
    part = F.shiftright(F.col("place"), PART).alias("part")
    owners = passages.select(F.col("base").alias("place"), "_row", "first")
    both = owners.select(part, "place", F.lit(0).alias("ord"), "_row", "first").union(later.select(part, "place", F.lit(1), F.lit(0).cast("long"), F.lit(0)))
    dealt = both.repartition("part").sortWithinPartitions("place", "ord").select("place", "ord", "_row", "first")

    def merge(batches):
        owner = None
        begin = end = None
        row, first, last = [], [], []

        def close():
            nonlocal begin
            if begin is not None:
                row.append(owner[1]), first.append(owner[2] + begin - owner[0]), last.append(owner[2] + end - owner[0] + size)
                begin = None

        for batch in batches:
            for place, ord_, r, f in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ord_ == 0:
                    close()
                    owner = (place, r, f)
                elif begin is not None and place <= end + size:
                    end = place
                else:
                    close()
                    begin = end = place
            yield pa.RecordBatch.from_arrays([pa.array(row, type=pa.int64()), pa.array(first, type=pa.int32()), pa.array(last, type=pa.int32())], names=["_row", "first", "end"])
            row, first, last = [], [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(row, type=pa.int64()), pa.array(first, type=pa.int32()), pa.array(last, type=pa.int32())], names=["_row", "first", "end"])

    return dealt.mapInArrow(merge, "_row long, first int, end int")


def repeated_spans(rows: DataFrame, size: int) -> DataFrame:
    """(_row, first, end): words of ``rows`` (_row, _id, _text) in windows that also start earlier."""
    spark = rows.sparkSession
    phrases = block_phrases(rows.select("_row", "_text"), size)
    # a phrase has one row for each block that holds it, however often it occurs there
    total = F.sum("n").over(Window.partitionBy(F.xxhash64("phrase")))
    recurring = written(phrases.withColumn("total", total).where("total > 1").select("block", "phrase"), "phrases")
    release(spark)
    passages = written(ordered(written(locate(rows, recurring, size), "located"), rows.select("_row", "_id"), size), "passages")
    release(spark)
    folded = passages.groupBy("key").agg(F.min("base").alias("earliest"))
    met = passages.join(folded, "key")
    copies = met.where("base > earliest").select("_row", "first", (F.col("first") + F.col("n")).cast("int").alias("end"))
    windows = window_rows(met.where("base = earliest"), size)
    earliest = F.min("place").over(Window.partitionBy("w1", "w2"))
    across = windows.where("not later").withColumn("earliest", earliest).where("place > earliest")
    later = written(windows.where("later").select("place").union(across.select("place")), "later")
    release(spark)
    return written(copies.union(spans(passages, later, size)), "spans")


def without_repeats(df: DataFrame, size: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, removed, text): each row's text without repeated passages.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of
    ``size`` consecutive words around it also starts earlier: in a row with a
    smaller id, or earlier in the row. Null ids come last; rows with the same id
    come in the order they are read, so the first of equal rows keeps its words.
    ``removed`` lists the removed ranges of words, ``text`` has the kept words,
    parted by one space. A null text has no words; texts shorter than a window
    are kept. Other columns are not read. An empty table gives an empty result.
    """
    rows = numbered(df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")), "_id", "_text")
    removed = repeated_spans(rows, size).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))

    def cut(batches):
        for batch in batches:
            words, gone, ranges, kept = [], [], [], []
            for text, found in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                w = text.split()
                merged, parts, at = [], [], 0
                for s in found or ():
                    if merged and s["first"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(dict(s))
                for s in merged:
                    parts += w[at:s["first"]]
                    at = s["end"]
                parts += w[at:]
                words.append(len(w)), gone.append(len(w) - len(parts)), ranges.append(merged), kept.append(b" ".join(parts).decode())
            spans_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(ranges, type=spans_type), pa.array(kept, type=pa.string())], names=["_id", "n_words", "n_removed", "removed", "_kept"])

    kind = dict(rows.dtypes)["_id"]
    met = rows.join(removed, "_row", "left").select("_id", "_text", "spans")
    found = met.mapInArrow(cut, f"_id {kind}, n_words long, n_removed long, removed array<struct<first:int,end:int>>, _kept string")
    return found.select(F.col("_id").alias(id_column), "n_words", "n_removed", "removed", F.col("_kept").alias("text"))
