"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file's path is a parameter; every executor reads it from its own installation and builds
the encoder once a worker. Texts over ``LONG`` characters are cut at safe boundaries first, so the
pattern never scans a huge text at once: between a letter or digit and a following space, no
match of the pattern can span, so the pieces give the same ids as the whole. Runs of over ``RUN``
white-space characters never reach the pattern, whose engine recurses once a character of such a run:
all of a run but its last character, or the whole run at the end of a text, is one match of the pattern
and is merged as one piece.

Nulls count as empty texts (no ids, empty bytes); empty tables give empty results; repeated rows
are encoded each; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import lean, slices

#: Characters from which a text is cut before encoding, and the least length of a piece.
LONG = 1 << 16
#: White-space characters of a run from which the pattern does not see it.
RUN = 4096
# The white space of Unicode, which the pattern's \s means.
SPACE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


@lru_cache(maxsize=4)
def encoder(rank_path: str, pattern: str):
    """The tiktoken encoder of a rank file, without special tokens."""
    import base64

    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, least: int = LONG) -> Iterator[str]:
    """Cut ``text`` into pieces of at least ``least`` characters where no pattern match can span.

    A text without such a place stays whole.
    """
    begin = 0
    while len(text) - begin > least:
        cut = text.find(" ", begin + least)
        while cut > 0 and not text[cut - 1].isalnum():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


@lru_cache(maxsize=4)
def _runs(least: int) -> re.Pattern:
    return re.compile(f"[{SPACE}]{{{least},}}")


def parts_of(text: str, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is white space that is one match of the pattern."""
    at = 0
    for found in _runs(run).finditer(text):
        last = found.end() if found.end() == len(text) else found.end() - 1
        yield text[at : found.start()], False
        yield text[found.start() : last], True
        at = last
    yield text[at:], False


def encode_text(text: str | None, rank_path: str, pattern: str, least: int = LONG) -> list[int]:
    """Ids of one text."""
    if not text:
        return []
    coder = encoder(rank_path, pattern)
    if len(text) <= RUN:
        return coder.encode_ordinary(text)
    out: list[int] = []
    for part, blank in parts_of(text):
        if blank:
            out += coder._encode_single_piece(part)
        else:
            for piece in safe_pieces(part, least):
                out += coder.encode_ordinary(piece)
    return out


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``token_ids`` (array<int>) of every row."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [np.asarray(encode_text(text, rank_path, pattern), dtype=np.int32) for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[id_col, "token_ids"])
        encoder.cache_clear()  # a worker that waits need not hold the ranks

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(lean(work), f"`{id_col}` {kind}, token_ids array<int>")


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the raw bytes of ``token_ids``, which may end inside a character."""
    rows = encoded.drop("decoded")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(rank_path, pattern)
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index("token_ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([coder.decode_bytes(x or []) for x in ids], pa.binary())], names=[*batch.schema.names, "decoded"])
        del coder
        encoder.cache_clear()

    return rows.mapInArrow(lean(work), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary")


def id_digest(ids: Column) -> Column:
    """SHA-256, lowercase hex, of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids, " "), 256)
