"""Operator 10: WARC archives, written and read back.

Writing: one record a page, one gzip member a record (so that each can be read on its own), headers and
payload as HTTP responses. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the
largest page_id is the response; the others are revisits, which hold the HTTP headers only and refer to it.
Equal means equal SHA-256 and length; the digest written is SHA-1, as the format has it.

Files are written by the tasks into the shared folder under names of their own and renamed when complete. A
list of the files of the tasks that succeeded is written behind them; only what is listed is read, so a task
that runs twice leaves no record twice.

Reading: sequential and in bounded memory. The compressed bytes are read in pieces of ``PIECE``, inflated with
one zlib object a member, and framed by Content-Length; a record's digest is checked over its payload (for a
revisit: taken from its header, as the payload is elsewhere). A broken file raises.

Defined results: a null html has an empty payload; a null url is written as an empty one; rows of equal
page_id and payload are all responses; a null page_id counts as smaller than any, is written without a
number and read back as null.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import fresh, quoted
from threadlens.session import fresh_path, stage

REVISIT_BYTES = 1000
PIECE = 65_536
# A new file is begun after so many compressed bytes.
FILE_BYTES = 64_000_000
LEVEL = 6

# The version line, header names and the revisit profile of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> tuple[DataFrame, str]:
    """``pages`` and the name of a column behind it: the page_id that the row revisits, null for responses."""
    key, rep, reps, target = fresh(pages, "payload_key", "rep_key", "rep_id", "revisits")
    payload = F.coalesce(quoted(html_col), F.lit("")).cast("binary")
    large = F.octet_length(payload) >= REVISIT_BYTES
    # small payloads get a key of their own page, so that they do not meet in one task
    marked = pages.withColumn(
        key, F.when(large, F.concat(F.sha2(payload, 256), F.octet_length(payload).cast("string"))).otherwise(
            F.concat(F.lit("page "), F.coalesce(quoted(id_col).cast("string"), F.lit(""))))
    )
    largest = (
        marked.where(large)
        .groupBy(quoted(key).alias(rep))
        .agg(F.max(quoted(id_col)).alias(reps), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    other = ~quoted(id_col).eqNullSafe(F.col(reps)) & F.col(reps).isNotNull()
    joined = marked.join(largest, F.col(key) == F.col(rep), "left").withColumn(target, F.when(other, F.col(reps)))
    return joined.drop(key, rep, reps), target


def sha1_header(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None) -> bytes:
    """One record, not compressed."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisits is not None else http + payload
    digest = hashlib.sha1(payload).digest()
    # line breaks would end a header line
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Type", "response" if revisits is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", sha1_header(digest)),
        ("WARC-Block-Digest", sha1_header(hashlib.sha1(block).digest())),
        *([] if revisits is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{revisits}>")]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers).encode("utf-8", "surrogateescape")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write one record a row under ``folder``; returns the list of files (path, records, bytes), itself
    written to the shared folder."""
    held, target = roles(pages, id_col, html_col)
    rows = held.select(
        quoted(id_col).cast("long").alias("page_id"),
        quoted(url_col).cast("string").alias("url"),
        quoted(html_col).cast("binary").alias("html"),
        F.col(target).cast("long").alias("revisits"),
    )

    def write(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        out, temp, path, records, size = None, "", "", 0, 0

        def finish():
            out.close()
            store.move(temp, path)
            return pa.RecordBatch.from_pydict(
                {"path": pa.array([path], pa.string()), "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())}
            )

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page, url, html, revisits = (c[i].as_py() for c in columns)
                if out is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    temp, path, records, size = f"{root}/.{name}", f"{root}/{name}", 0, 0
                    out = store.open_output_stream(temp, compression=None)
                data = member(record(page, url, html or b"", revisits))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= FILE_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return stage(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-files")


class Members:
    """The inflated bytes of a gzip file, member by member, in pieces."""

    def __init__(self, source):
        self.source, self.rest = source, b""

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self.rest or self._more():
            yield self._member()

    def _more(self) -> bool:
        self.rest = self.source.read(PIECE)
        return bool(self.rest)

    def _member(self) -> Iterator[bytes]:
        inflater = zlib.decompressobj(31)
        while not inflater.eof:
            ended = not self.rest and not self._more()
            data = inflater.decompress(self.rest, PIECE)
            if ended and not data and not inflater.eof:
                raise ValueError("the file ends within a gzip member")
            self.rest = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
            if data:
                yield data


class Bytes:
    """Reads lines and lengths from an iterator of pieces, holding one piece and what is asked for."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def _fill(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def headers(self) -> list[bytes]:
        while b"\r\n\r\n" not in self.held:
            if not self._fill():
                raise ValueError("a header without end")
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        return head.split(b"\r\n")

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._fill():
                raise ValueError("a block shorter than its Content-Length")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def tail(self) -> bytes:
        while self._fill():
            pass
        return self.held


def fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "surrogateescape").split(":", 1) for line in lines)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_member(pieces: Iterator[bytes], keep_payload: bool = False) -> dict:
    """One record: framed by its Content-Length, digests verified."""
    data = Bytes(pieces)
    version, *lines = data.headers()
    if version != VERSION:
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    head = fields(lines)
    left = int(head["content-length"])
    block, payload, size, body = hashlib.sha1(), hashlib.sha1(), 0, []
    http: bytes | None = b""
    for piece in data.take(left):
        block.update(piece)
        if http is not None:
            http += piece
            if b"\r\n\r\n" not in http:
                continue
            front, _, piece = http.partition(b"\r\n\r\n")
            status, http = fields(front.split(b"\r\n")[1:]), None
        payload.update(piece)
        size += len(piece)
        if keep_payload:
            body.append(piece)
    if data.tail() != b"\r\n\r\n":
        raise ValueError("a record does not end with two line breaks")
    if http is not None:
        raise ValueError("no HTTP header in the block")
    revisit = head["warc-type"] == "revisit"
    stored = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-block-digest"] != sha1_header(block.digest()):
        raise ValueError(f"block digest differs in {head['warc-record-id']}")
    if not revisit and (stored != base64.b32encode(payload.digest()).decode() or size != int(status["content-length"])):
        raise ValueError(f"payload digest differs in {head['warc-record-id']}")
    return {
        "page_id": page_of(head["warc-record-id"]),
        "url": head["warc-target-uri"],
        "payload_bytes": int(status["content-length"]),
        "payload_digest": base64.b32decode(stored).hex(),
        "record_type": head["warc-type"],
        "refers_to": page_of(head.get("warc-refers-to")),
        "payload": b"".join(body) if keep_payload and not revisit else None,
    }


ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
KINDS = {
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
}


def read_warc(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of listed ``files`` (path): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and with ``payloads`` the payload (null for revisits)."""
    kinds = dict(KINDS) if payloads else {k: v for k, v in KINDS.items() if k != "payload"}

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, _ = open_store(folder)
                rows, held = [], 0
                with closing(store.open_input_stream(path, compression=None)) as source:
                    for pieces in Members(source):
                        found = read_member(pieces, payloads)
                        held += len(found["payload"] or b"")
                        rows.append(found)
                        if len(rows) >= 1000 or held >= FILE_BYTES:
                            yield _batch(rows, kinds)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    shape = ROW + (", payload binary" if payloads else "")
    # one row a file; a task a few files
    count = max(1, files.count())
    return files.select("path").repartition(count).mapInArrow(read, shape)


def _batch(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write ``pages`` to the shared folder and read them back."""
    folder = os.fspath(fresh_path(pages.sparkSession, "warc"))
    return read_warc(write_warc(pages, folder), folder, payloads)


SQL = f"""
with p as (
  select page_id, coalesce(html, '') as payload from pages
), r as (
  select *, max(page_id) over (partition by payload) as top from p
)
select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest,
  case when strlen(payload) >= {REVISIT_BYTES} and page_id <> top then 'revisit' else 'response' end as record_type,
  case when strlen(payload) >= {REVISIT_BYTES} and page_id <> top then top end as refers_to
from r
"""
