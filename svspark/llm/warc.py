"""WARC records in ZIP packages: write, and range-read without extraction.

A package is a ZIP archive of stored (uncompressed) members: ``archive/data.warc.gz`` with one
gzip member for each record, and ``indexes/index.cdx`` with offset and length of each.  The reader parses
the central directory, with ZIP64 fields, finds both members, and reads each record by its byte range.

Writers name packages by a fresh UUID; only packages listed in the written manifest count, so
files that a lost or repeated task left behind are never read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svspark.llm.store import Workspace, small

#: A package is closed at about so many compressed bytes; equal payloads of at least MIN_PAYLOAD bytes are stored once.
PACKAGE_BYTES, MIN_PAYLOAD = 8 << 20, 100
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI that executors share."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _line(value: str | None) -> str:
    return "".join(c if c.isprintable() else " " for c in value or "").strip()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def package(members: bytes, index: list[tuple[int, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((WARC, members), (INDEX, "".join(json.dumps({"offset": a, "length": n}) + "\n" for a, n in index).encode()), ("datapackage.json", b'{"profile": "data-package"}')):
            info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
            with z.open(info, "w", force_zip64=True) as f:
                f.write(data)
    return out.getvalue()


class Package:
    """Range reader of a ZIP archive whose wanted members are stored."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = dict(self._directory())

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _directory(self) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """Name to (local header, stored size, method) from the central directory."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack_from("<HII", tail, end + 10)
        if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = tail.rfind(b"PK\x06\x07", 0, end)
            if locator < 0:
                raise ValueError("no ZIP64 locator")
            record_at = struct.unpack_from("<Q", tail, locator + 8)[0]
            big = self.read(record_at, 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            entries, length, start = struct.unpack_from("<QQQ", big, 32)
        raw, at = self.read(start, length), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, full, n, extra, comment, local = struct.unpack_from("<10xH8xIIHHH8xI", raw, at)
            name = raw[at + 46 : at + 46 + n].decode()
            more, pos = raw[at + 46 + n : at + 46 + n + extra], 0
            while pos + 4 <= len(more):
                kind, size = struct.unpack_from("<HH", more, pos)
                if kind == 1:  # ZIP64: only the fields that are full in the directory, in this order
                    field = pos + 4
                    for which in ("full", "packed", "local"):
                        value = {"full": full, "packed": packed, "local": local}[which]
                        if value == 0xFFFFFFFF:
                            value = struct.unpack_from("<Q", more, field)[0]
                            field += 8
                        if which == "full":
                            full = value
                        elif which == "packed":
                            packed = value
                        else:
                            local = value
                pos += 4 + size
            yield name, (local, packed, method)
            at += 46 + n + extra + comment

    def place(self, name: str) -> tuple[int, int]:
        """First byte and length of a stored member."""
        local, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        n, extra = struct.unpack_from("<HH", self.read(local, 30), 26)
        return local + 30 + n + extra, size

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and block of each record of the index."""
        start, _ = self.place(WARC)
        at, n = self.place(INDEX)
        for line in self.read(at, n).splitlines():
            where = json.loads(line)
            raw = zlib.decompress(self.read(start + where["offset"], where["length"]), 31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD, work: Workspace | None = None) -> DataFrame:
    """Write every page as a record of some package below ``folder``; the manifest (path, records, bytes)."""
    work = work or Workspace(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    copies = rows.where(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    copies = work.save(copies, "copies")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = rows.join(small(copies, copies.count()), "digest", "left").select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches):
        files, where = open_fs(folder)
        data, index, size = [], [], 0

        def close():
            path = f"{where}/{uuid.uuid4().hex}.wacz"
            raw = package(b"".join(data), index)
            with files.open_output_stream(path) as f:
                f.write(raw)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([len(raw)], pa.int64())})

        files.create_dir(where, recursive=True)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for r in batch.slice(k, 64).to_pylist():
                    member = _gzip(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["kind"], r["refers_to"]))
                    data.append(member)
                    index.append((size, len(member)))
                    size += len(member)
                    if size >= PACKAGE_BYTES:
                        yield close()
                        data, index, size = [], [], 0
        if index:
            yield close()

    return work.save(told.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """Every record of the listed packages: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    payload is null for a revisit.  A response's digest and length are those of the bytes read; they must equal its headers'.
    """

    def run(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, where = open_fs(path)
                rows, held = [], 0
                with files.open_input_file(where) as f:
                    for h, block in Package(f, f.size()).records():
                        digest, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                        kind = h["WARC-Type"]
                        if kind == "response" and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, n):
                            raise ValueError(f"damaged record in {path}")
                        page = int(h["X-Page-ID"]) if h["X-Page-ID"] else None
                        rows.append((page, h["WARC-Target-URI"], n, digest, kind, int(h["X-Refers-To-Page-ID"]) if kind == "revisit" else None, block if kind == "response" else None))
                        held += len(block)
                        if held > 1 << 22:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    spread = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write all pages as packages in the shared folder and read every record back.

    Of rows with equal payloads of at least 100 bytes, those with the least page_id are responses, others revisit it.

    Defined cases: a null page is an empty payload; payloads below 100 bytes are always responses; a null page_id is a record without an id, never
    the target of a revisit if others have one; several rows with the least id are all responses; control characters
    in URLs become spaces in headers; an empty table gives no rows; other columns are ignored.
    """
    work = Workspace(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, f"{work.root}/packages", work=work, **options))
