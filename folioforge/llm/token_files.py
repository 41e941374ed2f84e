"""Token-ID files by plane shuffling.

A file holds the ids of consecutive documents as one stream, cut into blocks of a fixed number of
ids. Each block is transposed into byte planes (plane k holds byte k of every id) or bit planes,
planes above the block's largest id are left out, and each plane is compressed with zstandard on
its own. The chunk index behind the blocks has, for every block, its offset, number of ids, planes'
compressed sizes and a CRC-32, so a reader can fetch any range of ids without the rest.

Layout, little-endian::

    "PLANETOK" | u8 version | u8 kind (1 byte planes, 2 bit planes) | u16 zero | u32 ids a block
    blocks     | planes in ascending order
    documents  | zstd of int64 doc ids, zstd of int64 counts, zstd of validity bytes
    index      | for each block: u64 offset, u32 ids, u32 crc32, u16 planes, u32 size of each plane
    footer     | u64 index offset, u32 index crc32, u64 documents offset, 3 x u32 sizes, u64 ids,
               | u64 documents, u32 blocks, "PLANEEND"

``write_documents`` sorts the documents by id over range partitions; each task writes files with
names of its own and returns a row of the manifest for each, and only files in the manifest count,
so a repeated or lost task leaves at worst a file that nobody reads. Files end at document
boundaries and near ``file_ids`` ids. Rows that share an id are ordered, and dealt to tasks, by a hash of
their texts, so an id that many texts have is no task's alone.

Strings of the tokenizer's special tokens in a text become those tokens, as the library does it, or
ordinary text with ``special_as_text``.

Nulls count as empty texts, which give the end id alone; null ids sort first; rows of one id stand in
the order of their texts' hashes; an empty table writes no file; other columns are not looked at.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import lean, open_store, run_dir, slices, tidy

MAGIC, TAIL, VERSION = b"PLANETOK", b"PLANEEND", 1
HEAD, FOOT, ENTRY = struct.Struct("<8sBBHI"), struct.Struct("<QIQIIIQQI8s"), struct.Struct("<QIIH")
KINDS = {"byte": 1, "bit": 2}
MANIFEST = "part int, seq int, path string, n_ids long, n_docs long, n_bytes long, first_id long, last_id long"
#: Pieces that a worker keeps encoded.
CACHE = 1_000_000
#: Characters encoded together: the more, the fewer pieces are looked up twice, and the more memory a worker takes.
AT_ONCE = 8_000_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of uint32 ids, as many as its largest id needs."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range((top + 7) // 8)]
    bits = np.unpackbits(raw[:, : (top + 7) // 8], axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """Inverse of ``to_planes``."""
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    elif planes:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file to a binary stream; holds one block of ids at a time."""

    def __init__(self, out, block_ids: int = 1 << 16, kind: str = "byte", level: int = 3):
        import zstandard

        self.out, self.block_ids, self.kind = out, block_ids, kind
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.index: list[bytes] = []
        self.at = 0
        self._put(HEAD.pack(MAGIC, VERSION, KINDS[kind], 0, block_ids))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack(plane) for plane in to_planes(ids, self.kind)]
        body = b"".join(planes)
        self.index.append(ENTRY.pack(self.at, len(ids), zlib.crc32(body), len(planes)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        self._put(body)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            stream = np.concatenate(self.held)
            whole = len(stream) // self.block_ids * self.block_ids
            for begin in range(0, whole, self.block_ids):
                self._block(stream[begin : begin + self.block_ids])
            self.held, self.n_held = [stream[whole:]], len(stream) - whole

    def close(self) -> int:
        """Write what is held, the document table, the index and the footer; bytes written."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs_at = self.at
        parts = [
            self.pack(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes()),
            self.pack(np.array(self.counts, "<i8").tobytes()),
            self.pack(np.array([x is not None for x in self.doc_ids], np.uint8).tobytes()),
        ]
        for part in parts:
            self._put(part)
        index, index_at = b"".join(self.index), self.at
        self._put(index)
        self._put(FOOT.pack(index_at, zlib.crc32(index), docs_at, *map(len, parts), self.n_ids, len(self.counts), len(self.index), TAIL))
        return self.at


class PlaneReader:
    """Random access to one file through its chunk index."""

    def __init__(self, source):
        import zstandard

        self.unpack = zstandard.ZstdDecompressor().decompress
        self.source = source
        end = source.size()
        magic, version, kind, _, self.block_ids = HEAD.unpack(self._get(0, HEAD.size))
        index_at, crc, docs_at, a, b, c, self.n_ids, self.n_docs, blocks, tail = FOOT.unpack(self._get(end - FOOT.size, FOOT.size))
        if magic != MAGIC or tail != TAIL or version != VERSION:
            raise ValueError("not a token file")
        self.kind = {v: k for k, v in KINDS.items()}[kind]
        index = self._get(index_at, end - FOOT.size - index_at)
        if zlib.crc32(index) != crc:
            raise ValueError("the chunk index is damaged")
        self.entries, at = [], 0
        for _ in range(blocks):
            offset, n, block_crc, planes = ENTRY.unpack_from(index, at)
            sizes = struct.unpack_from(f"<{planes}I", index, at + ENTRY.size)
            self.entries.append((offset, n, block_crc, sizes))
            at += ENTRY.size + 4 * planes
        valid = np.frombuffer(self.unpack(self._get(docs_at + a + b, c)), np.uint8)
        ids = np.frombuffer(self.unpack(self._get(docs_at, a)), "<i8")
        self.doc_ids = [int(x) if ok else None for x, ok in zip(ids, valid, strict=True)]
        self.counts = np.frombuffer(self.unpack(self._get(docs_at + a, b)), "<i8")

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        offset, n, crc, sizes = self.entries[k]
        body = self._get(offset, sum(sizes))
        if zlib.crc32(body) != crc:
            raise ValueError(f"block {k} is damaged")
        ends = np.cumsum([0, *sizes])
        return from_planes([self.unpack(body[i:j]) for i, j in zip(ends, ends[1:], strict=False)], n, self.kind)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the stream; reads only the blocks that hold them."""
        if begin >= end:
            return np.empty(0, "<u4")
        first, last = begin // self.block_ids, (end - 1) // self.block_ids
        held = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return held[begin - first * self.block_ids : end - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start, ids) in order; holds one block and one document at a time."""
        held, k, start = np.empty(0, "<u4"), 0, 0
        for doc_id, n in zip(self.doc_ids, self.counts, strict=True):
            more = [held]
            have = len(held)
            while have < n:
                more.append(self.block(k))
                have += len(more[-1])
                k += 1
            held = np.concatenate(more) if len(more) > 1 else held
            yield doc_id, start, held[:n]
            held, start = held[n:], start + int(n)


class TextEncoder:
    """Encodes texts with the tokenizers library, each different word once.

    A text is cut before single spaces that stand between two characters that are not white space,
    and pieces seen for the first time further, at ``INSIDE``; no match of the tokenizer's pre-split
    spans such places, so the ids of the parts, joined, are the ids of the whole text. Ids are kept as
    little-endian uint32 bytes. A full cache takes no more; what it lacks is encoded each time. Texts
    that hold the string of an added token are encoded whole.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.special and special_as_text)]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = Pieces()
        self.sizes = token_sizes(self.tokenizer)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words. Words of one space and no other white space at an end are encoded together, many as one text."""
        out: list[bytes] = [b""] * len(words)
        joint = [k for k, w in enumerate(words) if w[:1] == " " and len(w) > 1 and not w[1].isspace() and not w[-1].isspace()] if self.sizes is not None else []
        for begin in range(0, len(joint), 20_000):
            places = joint[begin : begin + 20_000]
            texts = ["".join([words[k] for k in places[at : at + 500]]) for at in range(0, len(places), 500)]
            if self.added and any(map(self.added.search, texts)):
                continue
            ids = np.concatenate([np.array(found.ids, "<u4") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            tokens = np.cumsum(self.sizes[ids])
            ends = np.cumsum([len(words[k].encode()) for k in places])
            last = np.searchsorted(tokens, ends)
            if tokens[-1] != ends[-1] or not np.array_equal(tokens[last], ends):
                continue  # a token goes from one word to the next
            stream, at = ids.tobytes(), 0
            for k, end in zip(places, (4 * (last + 1)).tolist(), strict=True):
                out[k] = stream[at:end]
                at = end
        alone = [k for k, found in enumerate(out) if not found]
        for begin in range(0, len(alone), 20_000):
            places = alone[begin : begin + 20_000]
            for k, found in zip(places, self.tokenizer.encode_batch_fast([words[k] for k in places], add_special_tokens=False), strict=True):
                out[k] = array("I", found.ids).tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. The garbage collector rests: it would walk millions of live strings."""
        whole = {k for k, text in enumerate(texts) if text and self.added and self.added.search(text)}
        rests = gc.isenabled()
        gc.disable()
        try:
            out = self._encode([None if k in whole else text for k, text in enumerate(texts)])
        finally:
            if rests:
                gc.enable()
        for k in whole:
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _ids(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of different pieces that are not kept yet; they, and their parts, are kept while there is room."""
        kept, parts, lone = self.pieces, {}, {}
        for key in keys:
            # letters and digits alone are not cut
            found = () if key.isalnum() else INSIDE.split(piece_of(key))
            if len(found) > 1:
                parts[key] = [key_of(word) for word in found]
            else:
                lone[key] = None
        lone.update((w, None) for words in parts.values() for w in words if w not in kept)
        fresh = dict(zip(lone, self._words([piece_of(key) for key in lone]), strict=True))
        for key, words in parts.items():
            fresh[key] = b"".join([fresh[w] if w in fresh else kept[w] for w in words])
        if len(kept) < CACHE:
            kept.update((p, x) for p, x in fresh.items() if len(p) <= 64)
        return fresh

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        """Texts with single white space go through arrays: the pieces of all texts are numbered, each
        different one is looked up once, and the ids are gathered by number. Others are cut one by one."""
        if not texts:
            return []
        texts = ["" if text is None else text for text in texts]
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        numbered = pieces.flatten().dictionary_encode()
        number, words = numbered.indices.to_numpy(), numbered.dictionary.to_pylist()
        begins = pieces.offsets.to_numpy()[:-1]
        odd = blank_ended(numbered.dictionary)
        irregular = np.logical_or.reduceat(odd[number], begins)
        cuts = {k: cut(texts[k]) for k in np.flatnonzero(irregular).tolist()}
        firsts = {k: " " + words[number[begins[k]]] for k in np.flatnonzero(~irregular).tolist()}
        needed = np.zeros(len(words), bool)
        needed[number[~np.repeat(irregular, pieces.value_lengths().to_numpy())]] = True
        known = self.pieces.get
        bodies = [known(w) if need else b"" for w, need in zip(words, needed.tolist(), strict=True)]
        lacking = [k for k, body in enumerate(bodies) if body is None]
        more = set().union(firsts.values(), *cuts.values()).difference(self.pieces)
        fresh = self._ids(list(dict.fromkeys([*[words[k] for k in lacking], *more])))
        for k in lacking:
            bodies[k] = fresh[words[k]]
        self.pieces.fresh = fresh
        get = self.pieces.__getitem__
        values = np.frombuffer(b"".join(bodies), "<u4")
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4
        starts = np.cumsum(sizes) - sizes
        own = sizes[number]
        own[begins] = 0  # a text's first piece has no space before it
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[number] - (ends - own), own) + np.arange(total)
        stream = values[at]
        last = np.append(ends[begins[1:] - 1], total) if len(begins) else []
        out, begin = [], 0
        for k, end in enumerate(np.asarray(last).tolist()):
            out.append(b"".join(map(get, cuts[k])) if k in cuts else get(firsts[k]) + stream[begin:end].tobytes())
            begin = end
        return out


class Pieces(dict):
    """Ids of pieces; what is not kept comes from the batch at hand."""

    fresh: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        return self.fresh[key]


#: Between a letter or digit and a mark or line end; and behind a single line end, before a letter.
INSIDE = re.compile(r"(?<=[^\W_])(?=[.,;:!?|\n])|(?<=\S\n)(?=[^\W_])")


#: A single space between two characters that are not white space.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def blank_ended(words: pa.Array) -> np.ndarray:
    """Whether words are empty or have white space at an end."""
    sizes = pc.binary_length(pc.utf8_trim_whitespace(words)).to_numpy()
    return (sizes == 0) | (sizes < pc.binary_length(words).to_numpy())


def cut(text: str | None) -> list[str]:
    """Keys of a text's pieces: the piece without the space that it begins with; the first, which begins
    with none, behind a space."""
    if not text:
        return []
    places = [found.start() for found in BETWEEN.finditer(text)]
    ends = [*places, len(text)]
    return [" " + text[: ends[0]], *[text[a + 1 : b] for a, b in zip(places, ends[1:], strict=True)]]


def piece_of(key: str) -> str:
    return key[1:] if key[0] == " " else " " + key


def key_of(piece: str) -> str:
    """The key that ``piece_of`` makes a piece of."""
    return piece[1:] if piece[0] == " " and piece[1:2] not in ("", " ") else " " + piece


def joined(batches: Iterator[pa.RecordBatch], characters: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of several batches, or of a part of one, that have a number of characters together; the last text may
    go beyond it."""
    doc_ids, texts, held = [], [], 0
    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc_ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if held >= characters:
                yield doc_ids, texts
                doc_ids, texts, held = [], [], 0
    if texts:
        yield doc_ids, texts


def token_sizes(tokenizer) -> np.ndarray | None:
    """Bytes of each token, 0 for added ones; none if tokens do not stand for bytes of the text as it is."""
    form = json.loads(tokenizer.to_str())
    if form["normalizer"] is not None or (form["pre_tokenizer"] or {}).get("type") != "ByteLevel" or form["pre_tokenizer"]["add_prefix_space"]:
        return None
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    sizes = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)
    for token, k in vocabulary.items():
        sizes[min(k, len(sizes) - 1)] = len(token)
    return sizes if max(vocabulary.values(), default=0) < len(sizes) else None


@lru_cache(maxsize=2)
def text_encoder(path: str, special_as_text: bool = False) -> TextEncoder:
    return TextEncoder(path, special_as_text)


def write_documents(docs: DataFrame, tokenizer_path: str, end_id: int, directory: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 16, kind: str = "byte", file_ids: int = 1 << 26, special_as_text: bool = False) -> str:
    """Encode and write all documents in ascending id order; the folder with the files and their manifest.

    Without ``directory`` it is a working folder, which goes when the application ends.
    """
    spark = docs.sparkSession
    folder = directory or run_dir(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        store, base = open_store(folder)
        end = np.array([end_id], "<u4")
        writer = out = path = None
        first = last = None

        def done() -> pa.RecordBatch:
            n_bytes = writer.close()
            out.close()
            row = {"part": part, "seq": seq, "path": f"{folder}/files/{path}", "n_ids": writer.n_ids, "n_docs": len(writer.counts), "n_bytes": n_bytes, "first_id": first, "last_id": last}
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for doc_ids, texts in joined(batches, AT_ONCE):
            for doc_id, ids in zip(doc_ids, text_encoder(tokenizer_path, special_as_text).encode(texts), strict=True):
                if writer is None:
                    store.create_dir(f"{base}/files", recursive=True)
                    path = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.planes"
                    out = store.open_output_stream(f"{base}/files/{path}")
                    writer, first = PlaneWriter(out, block_ids, kind), doc_id
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
                last = doc_id
                if writer.n_ids >= file_ids:
                    yield done()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield done()

    with tidy(spark):
        ordered.mapInArrow(lean(work), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def manifest(spark, folder: str) -> DataFrame:
    """Files of a folder in stream order, with ``base``: the ids of all files before.

    The window runs in one task over one row a file of many million ids.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_documents(spark, folder: str, *, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 (and token_ids)."""
    files = manifest(spark, folder)
    kept = files.select("path", "base").repartition(max(1, spark.read.parquet(f"{folder}/manifest").count()), "path")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("token_ids", pa.list_(pa.int32()))] if with_ids else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = open_store(path)
                rows: list[tuple] = []
                with store.open_input_file(place) as source:
                    for doc_id, start, ids in PlaneReader(source).documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), *([ids.astype(np.int32)] if with_ids else [])))
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return kept.mapInArrow(lean(work), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids)
