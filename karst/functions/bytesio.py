"""Canonical bytes: big-endian integers and length-prefixed strings, for hashes that others can check."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_HASH = bytes(32)


def sha256(*parts: bytes) -> bytes:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.digest()


def u8(n: int) -> bytes:
    return struct.pack(">B", n)


def u16(n: int) -> bytes:
    return struct.pack(">H", n)


def u32(n: int) -> bytes:
    return struct.pack(">I", n)


def u64(n: int) -> bytes:
    return struct.pack(">Q", n)


def len32(b: bytes) -> bytes:
    return u32(len(b)) + b


def len64(b: bytes) -> bytes:
    return u64(len(b)) + b


class Reader:
    """Reads canonical bytes; anything short, long or out of bounds is a ValueError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("bytes end too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def len32(self) -> bytes:
        return self.take(self.uint(4))

    def expect(self, b: bytes) -> None:
        if self.take(len(b)) != b:
            raise ValueError("unexpected bytes")

    def end(self) -> None:
        if self.at != len(self.data):
            raise ValueError("bytes left over")


def col_uint(c: Column, n: int) -> Column:
    """An integer column as n big-endian bytes, in the JVM."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 2 * n, "0"))


def col_len32(b: Column) -> Column:
    return F.concat(col_uint(F.octet_length(b), 4), b)


def col_len64(b: Column) -> Column:
    return F.concat(col_uint(F.octet_length(b), 8), b)


def col_sha256(b: Column) -> Column:
    return F.unhex(F.sha2(b, 256))


def col_bytes(s: str | bytes) -> Column:
    return F.lit(bytearray(s.encode() if isinstance(s, str) else s))
