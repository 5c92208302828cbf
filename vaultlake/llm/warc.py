"""WARC archives: writing pages as records, and reading archives one record after another.

Writing: of pages with equal payloads (SHA-1, SHA-256 and length agree) of `LEAST_REVISIT` bytes or
more, the one with the largest page_id is a `response` record, the others are `revisit` records that
refer to it and hold the HTTP head only.  Each task writes archives of about `ARCHIVE_BYTES` into the
shared folder, one gzip member per record.  A file is written under a name of its attempt and then
renamed; only the files that the finished tasks name are in the manifest, so what a lost executor has
left is never read.

Reading: tasks take archives from the manifest and read each as a stream: zlib decompresses a bounded
piece at a time, the record's head gives the content length, the block and the payload are digested
while they pass, and lengths, digests and the end of the member are verified.  A record that fails
raises ValueError with the archive's name.

Paths are URIs of any file system that pyarrow knows (file, hdfs, s3, gs).

Defined cases: null html is an empty payload, and shorter payloads than LEAST_REVISIT are always
responses.  A null url becomes the page's record id.  Rows that repeat page_id and html are each
written, with equal record ids, all as responses if they are the largest of their group.  A null
page_id is written as such; a group of null ids only has no revisits.  Without pages there are no
archives.  Other columns are neither read nor written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlake.llm.common import body, checkpointed
from vaultlake.session import ensure_checkpoint_dir

LEAST_REVISIT = 1_000
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, record_type, refers_to of `pages` (page_id, url, html)."""
    rows = pages.select("page_id", "url", body("html").cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256), "n": F.octet_length("payload")})
    key = ["sha1", "sha256", "n"]
    # the texts are left behind before the shuffle; only groups of two or more are joined back
    groups = rows.where(F.col("n") >= LEAST_REVISIT).groupBy(*key).agg(F.max("page_id").alias("first"), F.count("*").alias("size"))
    rows = rows.join(groups.where("size > 1 and first is not null").drop("size"), key, "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{NAME}{'null' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    value = name.strip("<>").removeprefix(NAME)
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    target = _name(page_id).strip("<>") if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8")) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _write(home: str, most: int):
    def run(batches):
        where, path = fs.FileSystem.from_uri(home)
        out, name, n, size = None, None, 0, 0

        def close():
            out.close()
            where.move(f"{path}/.{name}", f"{path}/{name}")
            return pa.RecordBatch.from_pylist([{"path": f"{home}/{name}", "records": n, "bytes": size}])

        for batch in batches:
            for i in range(batch.num_rows):
                member = record(*(batch.column(c)[i].as_py() for c in range(5)))
                if out is None:
                    name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    where.create_dir(path, recursive=True)
                    out = where.open_output_stream(f"{path}/.{name}", compression=None)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, home: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives below the URI `home`; returns the manifest: path, records, bytes."""
    return checkpointed(plan_records(pages).mapInArrow(_write(home, archive_bytes), MANIFEST))


class _Members:
    """The gzip members of a stream, decompressed a bounded piece at a time."""

    def __init__(self, stream, piece: int = PIECE):
        self.stream, self.piece, self.raw = stream, piece, b""
        self.unzip, self.held = None, b""

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.piece)
        self.unzip, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bytes:
        """Some further bytes of the member; empty at its end."""
        while not self.unzip.eof:
            if not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    raise ValueError("the archive ends within a record")
            out = self.unzip.decompress(self.raw, self.piece)
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.held.find(mark)) < 0:
            piece = self.more()
            if not piece or len(self.held) > most:
                raise ValueError("a head without an end")
            self.held += piece
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            piece = self.held or self.more()
            if not piece:
                raise ValueError("a block shorter than its content length")
            yield piece[:n]
            self.held = piece[n:]
            n -= min(n, len(piece))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(stream, keep_payload: bool = False, piece: int = PIECE) -> Iterator[tuple]:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record."""
    source = _Members(stream, piece)
    while source.next_member():
        head = source.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        block, payload, http, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        inside = False
        for part in source.take(int(fields["content-length"])):
            block.update(part)
            if not inside:
                http += part
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                inside, part, http = True, http[at + 4 :], http[:at]
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        if not inside:
            raise ValueError("a block without an HTTP head")
        if b"".join(source.take(4)) != b"\r\n\r\n" or source.held or source.more():
            raise ValueError("a record does not end with its member")
        stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
        if base64.b32decode(fields["warc-block-digest"].removeprefix("sha1:")) != block.digest():
            raise ValueError("block digest differs")
        kind, length = fields["warc-type"], int(_fields(http)["content-length"])
        if kind == "response" and (size != length or payload.digest() != stated):
            raise ValueError("payload digest or length differs")
        refers = fields.get("warc-refers-to")
        yield (
            _id(fields["warc-record-id"]), fields["warc-target-uri"], length, stated.hex(), kind, None if refers is None else _id(refers),
            b"".join(kept) if keep_payload and kind == "response" else None,
        )


def _read(keep_payload: bool):
    names = [x.strip().split()[0] for x in RECORD.split(",")] + ["payload"] * keep_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * keep_payload

    def batch_of(rows):
        cols = list(zip(*rows))[: len(names)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                try:
                    with where.open_input_stream(path, compression=None) as stream:
                        for row in read_records(stream, keep_payload):
                            rows.append(row)
                            held += row[2] if keep_payload else 0
                            if len(rows) >= 2_000 or held > (8 << 20):
                                yield batch_of(rows)
                                rows, held = [], 0
                except (ValueError, KeyError, zlib.error) as wrong:
                    raise ValueError(f"{uri}: {wrong}") from wrong
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the archives that `manifest` (path) lists; with their payloads (null for
    revisits) if asked for."""
    paths = manifest.select("path").repartition("path")
    return paths.mapInArrow(_read(keep_payload), RECORD + (", payload binary" if keep_payload else ""))


def archive_home(spark: SparkSession) -> str:
    home = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    return home if "://" in home or home.startswith("/") else home.replace("file:/", "file:///", 1)
