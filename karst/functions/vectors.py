"""Vector functions (V1-V19): JVM expressions for a pair of vectors, numpy for blocks of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

METRICS = ("cosine", "dot", "l2")


def metric_or_cosine(name: str | None) -> str:
    """Search takes an unknown metric as cosine."""
    return name if name in METRICS else "cosine"


def vector_literal(v: list[float]) -> Column:
    """One constant, not a call per element; NaN and infinities as they are."""
    return F.expr("array(" + ", ".join(f"{x!r}D" if math.isfinite(x) else f"double('{x}')" for x in map(float, v)) + ")")


def _sum(a: Column, b: Column, f) -> Column:
    """Sum of f over the shorter of both, in DOUBLE."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(f(x.cast("double"), y.cast("double")), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or a vector is empty."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Greater is more similar: cosine, dot product, 1 / (1 + squared distance)."""
    return {"cosine": cosine, "dot": dot, "l2": lambda x, y: 1.0 / (1.0 + l2_squared(x, y))}[metric](a, b)


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is more similar: 1 - cosine, - dot product, squared distance."""
    return {"cosine": lambda x, y: 1.0 - cosine(x, y), "dot": lambda x, y: -dot(x, y), "l2": l2_squared}[metric](a, b)


def decayed(score: Column, ts_ms: Column, decay: float, now_ms: int, tau_hours: float) -> Column:
    """(1 - decay) * score + decay * exp(-age / tau); a row of the future has age 0."""
    decay = min(max(decay, 0.0), 1.0)
    if decay <= 0:
        return score
    age = F.greatest(F.lit(now_ms) - ts_ms, F.lit(0)) / 3_600_000.0
    return F.lit(1.0 - decay) * score + F.lit(decay) * F.exp(-age / F.lit(float(tau_hours)))


def normalized(a: Column) -> Column:
    """Unit vector; a copy where the squared norm is at most 1e-30."""
    n = norm(a)
    return F.when(n * n > 1e-30, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def sign_code(a: Column, centre: Column | None = None) -> Column:
    """Sign bits (x >= 0, of x - centre where given) as BIGINT words, most significant bit first; the last word is padded with 0."""
    d = F.zip_with(a, centre, lambda x, c: x.cast("double") - c.cast("double")) if centre is not None else a
    words = F.ceil(F.size(a) / 64).cast("int")

    def word(w: Column) -> Column:
        part = F.slice(d, w * 64 + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")))
        bits = F.concat(bits, F.array_repeat(F.expr("0L"), 64 - F.size(bits)))
        packed = F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))
        return packed

    return F.transform(F.sequence(F.lit(0), F.greatest(words - 1, F.lit(0))), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_similarity(a: Column, b: Column, dim: Column) -> Column:
    """1 - differing bits / stored bits; bits are stored in whole bytes."""
    return 1.0 - hamming(a, b) / (F.ceil(dim / 8) * 8)


@F.arrow_udf(ArrayType(FloatType()))
def bytes_to_vector(col: pa.Array) -> pa.Array:
    """Little-endian f32 bytes; null where the length is 0 or no multiple of 4. A batch is one buffer, read as it is."""
    n = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ok = (n > 0) & (n % 4 == 0)
    whole = b"".join(col.filter(pa.array(ok)).to_pylist()) if ok.any() else b""
    ends = np.append(0, np.cumsum(np.where(ok, n // 4, 0))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(whole, "<f4")), mask=pa.array(~ok))


@F.arrow_udf(BinaryType())
def vector_to_bytes(col: pa.Array) -> pa.Array:
    """The elements as little-endian f32 bytes."""
    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    data = col.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4").tobytes()
    ends = np.append(0, np.cumsum(4 * n)).astype(np.int32)
    out = pa.BinaryArray.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
    return pc.if_else(col.is_valid(), out, pa.scalar(None, pa.binary()))


@F.arrow_udf(BinaryType())
def sign_bytes(col: pa.Array) -> pa.Array:
    """The sign code as bytes; vectors of one length are packed together."""
    n = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    out: list = [None] * len(col)
    for size in np.unique(n[n >= 0]):
        rows = np.flatnonzero(n == size)
        bits = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size) >= 0
        for i, b in zip(rows.tolist(), np.packbits(bits, axis=1)):
            out[i] = b.tobytes()
    return pa.array(out, pa.binary())


def recall(found: Column, wanted: Column) -> Column:
    """Share of the wanted ids that were found."""
    return F.size(F.array_intersect(found, wanted)) / F.size(wanted)


def index_percentile(values: list[float], p: float) -> float:
    """The element at floor(n * p) of the sorted values."""
    return sorted(values)[min(len(values) - 1, math.floor(len(values) * p))]
