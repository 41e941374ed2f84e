"""WARC archives: a writer with revisit records and a salvage reader.

Every record is one gzip member. Of records with equal payloads of ``least`` bytes or more, the one
with the largest id is a response; the others become revisit records that name it and keep the HTTP
header, not the payload. Tasks write files with names of their own and return the manifest's rows;
files that the manifest lacks do not count, so a repeated task does no harm.

The salvage reader checks each member (gzip CRC), its version line, lengths and digests. After a
failed check it searches for the next place where a member or a plain version line starts a valid
record, reads on from there, and logs the bytes between as a quarantined gap. It reads archives
through a bounded window, never as a whole.

Null ids give records without id, which are responses; a null payload is empty; a null URL leaves
its header out; rows that repeat the largest id of a payload are responses all; an empty table
writes no file and reads as no record; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import open_store, run_dir, slices, tidy

# Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
#: Bytes read at once, and of a member at most: four times what a page's columns can hold.
STEP, MOST = 1 << 20, 1 << 34
MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
RECORDS = "path string, offset long, length long, kind string, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, reason string"


def b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record, uncompressed; control characters in header values are percent-encoded."""
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    for name, value in headers:
        if value is not None:
            lines.append(f"{name}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', value)}".encode("utf-8", "surrogatepass"))
    lines += [b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The response or revisit record of a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", None if page_id is None else f"<urn:page:{page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{b32(digest)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)], http)


def with_references(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: response). Groups are counted on narrow rows."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = base.where(F.octet_length("payload") >= least).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keys.join(groups, "digest").where("page_id < refers_to").dropDuplicates(["page_id", "digest"])
    return base.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_pages(pages: DataFrame, directory: str | None = None, *, least: int = 1000, date: str = "2000-01-01T00:00:00Z", level: int = 3, file_bytes: int = 1 << 27) -> str:
    """Write one record a row of ``pages`` (page_id, url, html); the folder with files and manifest."""
    spark = pages.sparkSession
    folder = directory or run_dir(spark, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        out, name, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/files/{name}", "n_records": n, "n_bytes": size}], schema=MANIFEST)

        for batch in slices(batches):
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(f"{base}/files", recursive=True)
                    out = store.open_output_stream(f"{base}/files/{name}", compression=None)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(page_record(page_id, url, payload, digest, refers_to, date)) + pack.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    with tidy(spark):
        with_references(pages, least).mapInArrow(work, "path string, n_records long, n_bytes long").write.parquet(f"{folder}/manifest")
    return folder


@dataclass
class Found:
    """A record, or a gap with its reason."""

    offset: int
    length: int
    kind: str
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class Window:
    """Bytes of a seekable source by offset; keeps a few steps."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        if not (self.at <= offset and offset + n <= self.at + len(self.held)):
            self.source.seek(offset)
            self.at, self.held = offset, self.source.read(max(n, STEP))
        return self.held[offset - self.at : offset - self.at + n]

    def find(self, marks: tuple[bytes, ...], offset: int) -> int:
        """The first place of any mark from ``offset`` on, or the end."""
        overlap = max(map(len, marks)) - 1
        while offset < self.size:
            data = self.get(offset, STEP)
            places = [p for p in (data.find(m) for m in marks) if p >= 0]
            if places:
                return offset + min(places)
            if offset + len(data) >= self.size:
                break
            offset += len(data) - overlap
        return self.size


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``; ValueError if a check fails."""
    if not data.startswith(b"WARC/1.", at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header has no colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isascii() or not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    end = stop + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the length is wrong")
    block = data[stop + 4 : end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("the block digest is wrong")
    return headers, block, end + 4


def member_at(window: Window, offset: int) -> tuple[bytes, int]:
    """Data and end of the gzip member at ``offset``; ValueError if it is damaged."""
    unpack, parts, total, at = zlib.decompressobj(31), [], 0, offset
    try:
        while not unpack.eof:
            # small steps at first: most members are short, and false starts fail at once
            step = window.get(at, min(STEP, 1 << 14 if at == offset else STEP))
            if not step:
                raise ValueError("the member is cut off")
            parts.append(unpack.decompress(step, MOST + 1 - total))
            total += len(parts[-1])
            if total > MOST:
                raise ValueError("the member is too large")
            at += len(step)
    except zlib.error as error:
        raise ValueError(f"the member is damaged ({error})") from None
    return b"".join(parts), at - len(unpack.unused_data)


#: How a record begins: its version line and the name of a header.
BEGINNING = re.compile(rb"WARC/1\.\d\r\n[!-9;-~]+[ \t]*:")


def plain_at(window: Window, offset: int) -> tuple[bytes, int]:
    """The uncompressed record at ``offset`` and its end. Nothing is read whole before its ends are seen."""
    if not BEGINNING.match(window.get(offset, 1 << 12)):
        raise ValueError("no version line")
    stop = window.find((b"\r\n\r\n",), offset)
    if stop == window.size:
        raise ValueError("headers do not end")
    length = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,15})[ \t]*\r\n", window.get(offset, stop + 2 - offset), re.IGNORECASE)
    if not length:
        raise ValueError("no content length")
    end = stop + 8 + int(length[1])
    if end > window.size or window.get(end - 4, 4) != b"\r\n\r\n":
        raise ValueError("the length is wrong")
    data = window.get(offset, end - offset)
    parse(data)
    return data, end


def records_at(window: Window, offset: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
    """All records of the member or plain record at ``offset``, and where the next starts."""
    if window.get(offset, 3) == MEMBER:
        data, end = member_at(window, offset)
    else:
        data, end = plain_at(window, offset)
    found, at = [], 0
    while at < len(data):
        headers, block, at = parse(data, at)
        found.append((headers, block))
    if not found:
        raise ValueError("no record")
    return found, end


def salvage(source, size: int) -> Iterator[Found]:
    """Records and quarantined gaps of an archive, in order."""
    window, offset = Window(source, size), 0
    while offset < size:
        try:
            found, end = records_at(window, offset)
        except ValueError as error:
            begin, reason, found, end = offset, str(error), [], size
            while not found and offset < size:
                offset = window.find((MEMBER, b"WARC/1."), offset + 1)
                if offset < size:
                    try:
                        found, end = records_at(window, offset)
                    except ValueError:
                        continue
            yield Found(begin, offset - begin, "gap", reason)
        for headers, block in found:
            yield Found(offset, end - offset, "record", None, headers, block)
        offset = end


def row_of(path: str, found: Found, with_payload: bool) -> dict:
    """A row of RECORDS; length and digest are those of the full payload, also of revisits."""
    row = {"path": path, "offset": found.offset, "length": found.length, "kind": found.kind, "reason": found.reason}
    if found.kind == "gap":
        return row
    h, block = found.headers, found.block
    http, split, payload = block.partition(b"\r\n\r\n")
    is_http = h.get("content-type", "").startswith("application/http") and bool(split)
    payload = payload if is_http else block
    n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    if h.get("warc-type") == "revisit":
        length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", http, re.IGNORECASE)
        named = h.get("warc-payload-digest", "")
        n = int(length[1]) if length else None
        digest = base64.b32decode(named[5:]).hex() if re.fullmatch("sha1:[A-Z2-7]{32}", named) else None
        payload = None
    return row | {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "payload_bytes": n, "payload_digest": digest, "payload": payload if with_payload else None}


def read_archives(archives: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named by the column ``path``, as RECORDS.

    With a column ``n_records``, reading fails if an archive gives another number of records.
    """
    counted = "n_records" in archives.columns
    types = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("reason", pa.string())]
    schema = pa.schema(types)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = open_store(path)
                with store.open_input_file(place) as source:
                    rows, held, n = [], 0, 0
                    for found in salvage(source, source.size()):
                        n += found.kind == "record"
                        rows.append(row_of(path, found, with_payload))
                        held += len(rows[-1].get("payload") or b"")
                        if len(rows) >= 1000 or held >= 32 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if expected and n != expected[0]:
                        raise RuntimeError(f"{path} has {n} readable records of {expected[0]} written")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("path", *["n_records"] * counted).mapInArrow(work, RECORDS)


def read_folder(spark, folder: str, *, with_payload: bool = True) -> DataFrame:
    """Records of a folder that ``write_pages`` made; one task a file. Fails if any is missing."""
    files = spark.read.schema("path string, n_records long, n_bytes long").parquet(f"{folder}/manifest")
    return read_archives(files.repartition(max(1, files.count()), "path"), with_payload=with_payload)
