"""BAM files as a DataFrame: BGZF blocks are inflated and records decoded file by file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
SCHEMA = "name string, flag int, chromosome string, position long, mapq int, cigar string, mate_chromosome string, mate_position long, insert_size long, seq string, qual string, barcode string"


def inflate(raw: bytes) -> bytes:
    """All gzip members of a BGZF file."""
    out = []
    while raw:
        z = zlib.decompressobj(31)
        out.append(z.decompress(raw) + z.flush())
        raw = z.unused_data
    return b"".join(out)


def _tag(raw: bytes, wanted: bytes) -> str | None:
    size = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
    at = 0
    while at + 3 <= len(raw):
        tag, kind, at = raw[at : at + 2], raw[at + 2 : at + 3], at + 3
        if kind in (b"Z", b"H"):
            end = raw.index(b"\x00", at)
            if tag == wanted and kind == b"Z":
                return raw[at:end].decode()
            at = end + 1
        elif kind == b"B":
            at += 5 + size[raw[at : at + 1]] * struct.unpack_from("<I", raw, at + 1)[0]
        else:
            at += size[kind]
    return None


def records(data: bytes) -> Iterator[tuple]:
    """Decoded rows of an inflated BAM file; positions are 1-based."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    names = []
    for _ in range(n):
        k = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + k].decode())
        at += 8 + k
    while at + 4 <= len(data):
        size = struct.unpack_from("<i", data, at)[0]
        ref, pos, bits, flag_cigar, length, mate, mate_pos, insert = struct.unpack_from("<iiIIiiii", data, at + 4)
        flag, ops, mapq, k = flag_cigar >> 16, flag_cigar & 0xFFFF, bits >> 8 & 0xFF, bits & 0xFF
        p = at + 36
        name = data[p : p + k - 1].decode()
        p += k
        cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{ops}I", data, p)) or "*"
        p += 4 * ops
        packed = data[p : p + (length + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:length] or "*"
        p += len(packed)
        qual = data[p : p + length]
        p += length
        text = "*" if not qual or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
        where = lambda r: names[r] if r >= 0 else None
        yield name, flag, where(ref), pos + 1, mapq, cigar, where(mate), mate_pos + 1, insert, seq, text, _tag(data[p : at + 4 + size], b"CB")
        at += 4 + size


def read_bam(spark: SparkSession, path: str, batch: int = 10_000) -> DataFrame:
    """Alignments of BAM files, a task for each file."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for r in records(inflate(bytes(content))):
                    rows.append(r)
                    if len(rows) == batch:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)
