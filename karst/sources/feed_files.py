"""Binary change-feed files (S15): checksummed frames, read in parallel by file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HEADER = struct.Struct("<IBQ")  # CRC-32C of the payload, type, length
SET, DELETE, VINSERT, VDELETE = 1, 2, 3, 4  # fixed values of the frame format
TYPES = {SET: "set", DELETE: "delete", VINSERT: "vinsert", VDELETE: "vdelete"}
LONGEST = 100 << 20
RECORD = "file string, place long, record_type string, key string, value string, is_worm boolean, timestamp long, namespace string, metric string"


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


CRC = _crc_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = CRC[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


class Corruption(ValueError):
    pass


def frame(kind: str, key: bytes, value: bytes = b"", worm: bool = False, ts_ms: int = 0, namespace: bytes = b"", metric: bytes = b"") -> bytes:
    code = {v: k for k, v in TYPES.items()}[kind]
    if code == SET:
        p = struct.pack("<HIBQ", len(key), len(value), worm, ts_ms) + key + value
    elif code == DELETE:
        p = struct.pack("<H", len(key)) + key
    elif code == VINSERT:
        p = struct.pack("<HHHBQ", len(key), len(namespace), len(metric), worm, ts_ms) + key + namespace + metric
    else:
        p = struct.pack("<HH", len(key), len(namespace)) + key + namespace
    return HEADER.pack(crc32c(p), code, len(p)) + p


def frames(data: bytes) -> Iterator[tuple]:
    """(record_type, key, value, is_worm, timestamp, namespace, metric) of each frame; a torn end ends quietly, a wrong checksum is ``Corruption``."""
    at = 0
    while at + HEADER.size <= len(data):
        crc, code, n = HEADER.unpack_from(data, at)
        at += HEADER.size
        if not 0 < n <= LONGEST:
            raise Corruption(f"length {n} at {at}")
        if at + n > len(data):
            return
        p = data[at : at + n]
        at += n
        if crc32c(p) != crc or code not in TYPES:
            raise Corruption(f"frame before {at}")
        try:
            yield (TYPES[code], *_fields(code, p))
        except (struct.error, ValueError) as e:
            raise Corruption(f"frame before {at}") from e


def _cut(p: bytes, at: int, *lengths: int) -> list[bytes]:
    if at + sum(lengths) != len(p):
        raise ValueError("length")
    out = []
    for n in lengths:
        out.append(p[at : at + n])
        at += n
    return out


def _fields(code: int, p: bytes) -> tuple:
    if code == SET:
        k, v, flags, ts = struct.unpack_from("<HIBQ", p)
        key, value = _cut(p, 15, k, v)
        return key, value, bool(flags & 1), ts, None, None
    if code == DELETE:
        (key,) = _cut(p, 2, *struct.unpack_from("<H", p))
        return key, None, None, None, None, None
    if code == VINSERT:
        k, n, m, flags, ts = struct.unpack_from("<HHHBQ", p)
        key, ns, metric = _cut(p, 15, k, n, m)
        return key, None, bool(flags & 1), ts, ns, metric
    key, ns = _cut(p, 4, *struct.unpack_from("<HH", p))
    return key, None, None, None, ns, None


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """``RECORD`` rows of all files below ``path``; ``place`` counts the records of a file. A file is one task's."""

    def work(batches):
        for b in batches:
            for name, data in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                rows = []
                for i, r in enumerate(frames(data)):
                    text = [x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in r]
                    rows.append((name, i, *text))
                    if len(rows) == 8192:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    def _batch(rows):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, RECORD)
