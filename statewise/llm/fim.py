"""Fill-in-middle: texts cut at two unit borders and put together in another order.

Secondary sort: each document goes out as chunks of whole units, keyed by document
and place in the output. One shuffle brings a document's pieces to one partition,
where they are sorted and streamed into a digest, so no task needs a whole output
text. The stream is then read as a consumer would read it: its marks alone say which
section a piece belongs to, the pieces get their places in the source text, and a
second sort within the same partitions (no shuffle) streams the restored text.

The key is the document, and a piece holds at most ``PIECE`` characters, so a
source with a third of the rows or a very long text makes no large group; sorts
beyond a worker's memory spill.

Defined cases: a null text is an empty one and stays plain, as does a text that holds
a mark; a null doc_id counts as an empty number in the draw; repeated rows are
documents of their own; columns other than the two read are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16  # characters of a piece at most
PARTITION_BYTES = 16 << 20  # text that one partition sorts, on average
MARKS = {"P": "<P>", "S": "<S>", "M": "<M>"}
ORDER = {"psm": "PSM", "spm": "SPM"}  # sections of an output text
PLACE = {"P": 0, "M": 1, "S": 2}  # sections of a source text
_LAST = len(PLACE)
_ANY_MARK = re.compile("|".join(map(re.escape, MARKS.values())))


def unit_ends(text: str) -> list[int]:
    """Ends of the units ``[^\\n]*\\n|[^\\n]+``."""
    ends = [m.end() for m in re.finditer("\n", text)]
    return ends if not text or text.endswith("\n") else [*ends, len(text)]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit draws that depend on the seed and the document alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def cut(doc_id: int | None, text: str, seed: int, rate: int, spm_rate: int) -> tuple[str, int, int, int]:
    """Form, number of units, and where prefix and middle end (characters)."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or _ANY_MARK.search(text):
        return "plain", n, 0, len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    border = [0, *ends]
    return "spm" if h4 % 100 < spm_rate else "psm", n, border[a], border[b]


def chunks(text: str, start: int, stop: int) -> Iterator[str]:
    """The range in pieces of whole units; a longer unit is cut where it must be."""
    while stop - start > PIECE:
        end = text.rfind("\n", start, start + PIECE) + 1 or start + PIECE
        yield text[start:end]
        start = end
    yield text[start:stop]


def emitted(part: int, rows: Iterator, seed: int, rate: int, spm_rate: int) -> Iterator[tuple]:
    """((row, place in the output), (piece, facts)); the first piece of a row has its facts."""
    for i, (doc_id, text) in enumerate(rows):
        row, text = (part << 33) + i, text or ""
        form, n, a, b = cut(doc_id, text, seed, rate, spm_rate)
        if form == "plain":
            facts, pieces = (doc_id, n, form, None, None), chunks(text, 0, len(text))
        else:
            facts = (doc_id, n, form, a, b - a)
            ranges = {"P": (0, a), "M": (a, b), "S": (b, len(text))}
            pieces = (p for s in ORDER[form] for p in (MARKS[s], *chunks(text, *ranges[s])) if p)
        for place, piece in enumerate(pieces):
            yield (row, place), (piece, None if place else facts)


class Reader:
    """Tells the sections of an output text apart as its pieces arrive."""

    def __init__(self, form: str):
        self.due = list(ORDER.get(form, ""))
        self.section, self.rest = "P", ""

    def read(self, piece: str) -> Iterator[tuple[str, str]]:
        piece = self.rest + piece
        self.rest = ""
        while self.due:
            mark = MARKS[self.due[0]]
            at = piece.find(mark)
            if at < 0:
                keep = len(mark) - 1  # a mark may begin here and end in the next piece
                self.rest, piece = piece[-keep:], piece[:-keep]
                break
            yield self.section, piece[:at]
            self.section, piece = self.due.pop(0), piece[at + len(mark):]
        yield self.section, piece


def assembled(items: Iterator[tuple], texts: bool) -> Iterator[tuple]:
    """Sorted output pieces into digests, and the pieces again by their place in the source.

    Yields ((row, section, number), piece), and after a row's last piece
    ((row, _LAST, 0), (facts, digest, output or None)).
    """
    for row, pieces in groupby(items, key=lambda kv: kv[0][0]):
        digest, reader, facts, number, whole = hashlib.sha256(), None, None, 0, []
        for _, (piece, first) in pieces:
            if first is not None:
                facts, reader = first, Reader(first[2])
            digest.update(piece.encode())
            if texts:
                whole.append(piece)
            for section, part in reader.read(piece):
                if part:
                    yield (row, PLACE[section], number), part
                    number += 1
        yield (row, _LAST, 0), (facts, digest.hexdigest(), "".join(whole) if texts else None)


def restored(items: Iterator[tuple]) -> Iterator[tuple]:
    """Source pieces in order into digests; a row of the result after the last one."""
    digest = hashlib.sha256()
    for (_, section, _), value in items:
        if section < _LAST:
            digest.update(value.encode())
            continue
        facts, output_sha256, output = value
        yield (*facts, output_sha256, digest.hexdigest(), output)
        digest = hashlib.sha256()


def row_of(key: tuple) -> int:
    return key[0]


def output_pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> RDD:
    """((row, place), (piece, facts)) sorted by row and place, a row's pieces in one partition."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    pieces = docs.select(id, text).rdd.mapPartitionsWithIndex(lambda part, it: emitted(part, it, seed, rate, spm_rate))
    return pieces.repartitionAndSortWithinPartitions(parts, row_of)


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, texts: bool = True) -> DataFrame:
    """Transformed documents with digests of the output and of the text restored from it.

    ``rate`` and ``spm_rate`` are percentages. Columns: the id, n (units), form
    (plain, psm, spm), prefix_chars, middle_chars (null if plain), output_sha256,
    restored_sha256, and output, the text itself (left null if not ``texts``; then no
    task holds more of a document than its pieces in the sorter's memory).
    """
    sorted_pieces = output_pieces(docs, id, text, seed, rate, spm_rate)
    by_source = sorted_pieces.mapPartitions(lambda it: assembled(it, texts), preservesPartitioning=True)
    # the same partitioner again: rows stay where they are and are only sorted anew
    resorted = by_source.repartitionAndSortWithinPartitions(sorted_pieces.getNumPartitions(), row_of)
    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"
    return docs.sparkSession.createDataFrame(resorted.mapPartitions(restored), schema, verifySchema=False)
