"""Token counts without token ids: pieces are counted once for each distinct pre-token."""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.llm.common import numbered, texts_of, written
from statewise.llm.lexicon import FLUSH_UNITS, by_row, frequent, unit_counts

# Fixed value: the split of byte-level BPE before its merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


CACHED_CHUNKS = 300_000


class Splitter:
    """Pre-tokens of texts; strings of special tokens stand alone, as the library takes them.

    A space after a character that is no white space always starts a pre-token.
    So a text in which no space touches other white space falls at its spaces
    into chunks that split alone, and a chunk seen before is not split again.
    """

    def __init__(self, specials: tuple[str, ...]):
        self.pieces = regex.compile(PRE_TOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.marks = specials
        self.touching = re.compile(r"\s | \s")

    def whole(self, text: str) -> list[str]:
        if self.special is None or not any(m in text for m in self.marks):
            return self.pieces.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self.pieces.findall(part)
        return out

    def chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Chunks that stand after a space, and the pre-tokens of all that is not in chunks."""
        if any(m in text for m in self.marks) or self.touching.search(text) or text[-1:] == " ":
            return [], self.whole(text)
        first, *rest = text.split(" ")
        return rest, self.pieces.findall(first)

    def of_chunk(self, chunk: str) -> list[str]:
        return self.pieces.findall(" " + chunk)


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _library(path).get_added_tokens_decoder().values())


def piece_counts(units: DataFrame, path: str) -> DataFrame:
    """(unit, n) -> (unit, n, pieces): tokens of each distinct pre-token, by the library."""

    def tokenize(batches):
        library = _library(path)
        for batch in batches:
            sizes = [len(e.ids) for e in library.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, type=pa.int32())], names=["unit", "n", "pieces"])

    return units.select("unit", "n").mapInArrow(tokenize, "unit string, n long, pieces int")


def token_counts(df: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``df``.

    ``path`` is the vocabulary file of the ``tokenizers`` library. A null text
    counts as empty (0 bytes, 0 tokens); null and repeated ids and repeated rows
    keep a row each; other columns of ``df`` are not read. An empty table gives
    an empty result.
    """
    specials = special_strings(path)
    rows = numbered(df, id_column, text_column)

    def units(batches):
        split, chunks, pieces = Splitter(specials), Counter(), Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                inner, outer = split.chunks(text)
                chunks.update(inner)
                pieces.update(outer)
                if len(chunks) + len(pieces) > FLUSH_UNITS:
                    yield pieces, chunks, split.of_chunk
                    chunks.clear(), pieces.clear()
        yield pieces, chunks, split.of_chunk

    lexicon = written(piece_counts(unit_counts(rows.select(text_column), units), path), "pieces")
    hot = df.sparkSession.sparkContext.broadcast(frequent(lexicon, "pieces"))
    kind = rows.schema[id_column].dataType.simpleString()

    def count(batches):
        split, known = Splitter(specials), hot.value

        def valued(chunk):
            """Tokens of a chunk, or its frequent part and its rare pre-tokens."""
            found = split.of_chunk(chunk)
            got = [known.get(piece) for piece in found]
            rare = [piece for piece, p in zip(found, got, strict=True) if p is None]
            total = sum(p for p in got if p is not None)
            return (total, rare) if rare else total

        cache: dict = {}
        for batch in batches:
            row, unit, n, tokens, size, ids = [], [], [], [], [], []
            for r, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                inner, outer = split.chunks(text)
                total, rare = 0, {}
                for piece in outer:
                    p = known.get(piece)
                    if p is None:
                        rare[piece] = rare.get(piece, 0) + 1
                    else:
                        total += p
                for chunk, p in zip(inner, map(cache.get, inner), strict=True):
                    if p is None:
                        p = cache[chunk] = valued(chunk)
                    if p.__class__ is int:
                        total += p
                    else:
                        total += p[0]
                        for piece in p[1]:
                            rare[piece] = rare.get(piece, 0) + 1
                if len(cache) > CACHED_CHUNKS:
                    cache.clear()
                unit += rare
                n += rare.values()
                blank = [None] * len(rare)
                row += [r] * (len(rare) + 1)
                unit.append(None), n.append(0)
                tokens += blank + [total]
                size += blank + [len(text.encode())]
                ids += blank + [i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, type=pa.int64()), pa.array(unit, type=pa.string()), pa.array(n, type=pa.int32()), pa.array(tokens, type=pa.int64()), pa.array(size, type=pa.int64()), pa.array(ids, type=batch.schema.field(1).type)],
                names=["_row", "unit", "n", "n_tokens", "n_bytes", "_id"],
            )

    long = rows.mapInArrow(count, f"_row long, unit string, n int, n_tokens long, n_bytes long, _id {kind}")
    summed = by_row(long, lexicon.select("unit", "pieces"), {"n_tokens": F.col("n") * F.col("pieces")}, ["n_bytes", "_id"])
    return summed.select(F.col("_base._id").alias(id_column), F.col("_base.n_bytes").alias("n_bytes"), F.col("n_tokens"), (F.col("n_tokens") > limit).alias("over_limit"))
