"""Ed25519 (RFC 8032) in plain Python, for executors that have no crypto library."""

from __future__ import annotations

import hashlib

P = 2**255 - 19
Q = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    x2 = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(x2, (P + 3) // 8, P)
    if (x * x - x2) % P:
        x = x * ROOT % P
    if (x * x - x2) % P or x == 0 and odd:
        return None
    return P - x if x & 1 != odd else x


_BY = 4 * pow(5, P - 2, P) % P
_BX = _x_of(_BY, 0) or 0
BASE: Point = (_BX, _BY, 1, _BX * _BY % P)


def _add(a: Point, b: Point) -> Point:
    m, n = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = n - m, d - c, d + c, n + m
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: Point) -> Point:
    r: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            r = _add(r, p)
        p = _add(p, p)
        n >>= 1
    return r


def _pack(p: Point) -> bytes:
    z = pow(p[2], P - 2, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(b: bytes) -> Point | None:
    y = int.from_bytes(b, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    x = _x_of(y, odd)
    return None if x is None else (x, y, 1, x * y % P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _expand(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_expand(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, rest = _expand(seed)
    pub = _pack(_times(a, BASE))
    r = _hash(rest, message) % Q
    big = _pack(_times(r, BASE))
    return big + ((r + _hash(big, pub, message) * a) % Q).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= Q:
        return False
    left, right = _times(s, BASE), _add(r, _times(_hash(signature[:32], public, message) % Q, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0
