"""Quantized vectors (P13, V12-V17): a centred, rotated sign code with an estimator of the squared distance.

The centroid is a mean over the namespace, by JVM aggregation; the rotation is drawn on the driver from the namespace's
hash (dim x dim floats). Codes are derived, so they are always made anew. Encoding and estimation are matrix products over Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values of FNV-1a, 64 bits


def fnv1a64(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Params:
    metric: str
    centroid: np.ndarray
    matrix: np.ndarray


def centroid(entries: DataFrame, metric: str = "cosine") -> DataFrame:
    """(pos, mean) of each dimension, in DOUBLE; cosine takes unit vectors and leaves zero vectors out. Null elements count as absent.

    Vectors are added up in each task, so one row per dimension and task is shuffled.
    """

    def add(batches):
        total, n = np.zeros(0), np.zeros(0, np.int64)
        for b in batches:
            col = b.column(0)
            lengths = col.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                x = col.take(pa.array(np.flatnonzero(lengths == size))).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size)).astype(np.float64)
                here = ~np.isnan(x) if x.dtype.kind == "f" else np.ones(x.shape, bool)
                x = np.where(here, x, 0)
                if metric == "cosine":
                    norm = np.sqrt((x * x).sum(1))
                    keep = norm > 0
                    x, here = x[keep] / norm[keep, None], here[keep]
                if size > len(total):
                    total, n = np.pad(total, (0, size - len(total))), np.pad(n, (0, size - len(n)))
                total[:size] += x.sum(0)
                n[:size] += here.sum(0)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(len(total)), pa.int32()), "s": total, "n": n})

    d = entries.filter(F.size("vector") > 0).select(F.col("vector").cast("array<float>").alias("vector"))
    parts = d.mapInArrow(add, "pos int, s double, n long").filter("n > 0")
    return parts.groupBy("pos").agg((F.sum("s") / F.sum("n")).alias("mean"))


def fit(entries: DataFrame, ns: str, metric: str = "cosine") -> Params:
    """Parameters of a namespace; one row per dimension reaches the driver."""
    rows = centroid(entries.filter(F.col("key").startswith(ns)), metric).orderBy("pos").collect()
    c = np.array([r["mean"] for r in rows])
    return Params(metric, c, rotation(len(c), fnv1a64(ns.encode())))


def _residual(x: np.ndarray, p: Params) -> np.ndarray:
    if p.metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n > 1e-15, n, 1)
    return x - p.centroid


def encode(x: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code bits, residual norms and the codes' correlation with their residuals; a zero residual has norm 0, code 0 and correlation 1."""
    r = _residual(x.astype(np.float64), p)
    norm = np.linalg.norm(r, axis=1)
    some = norm > 1e-15
    o = (r / np.where(some, norm, 1)[:, None]) @ p.matrix.T
    bits = (o >= 0) & some[:, None]
    corr = np.where(some, np.abs(o).sum(1) / np.sqrt(x.shape[1]), 1.0)
    return bits, np.where(some, norm, 0.0), corr


def estimate(bits: np.ndarray, norm: np.ndarray, corr: np.ndarray, query: np.ndarray, p: Params) -> np.ndarray:
    """Squared distances to the query; infinite where the correlation is below 1e-8."""
    q = _residual(query.astype(np.float64)[None], p)[0]
    qn = np.linalg.norm(q)
    o = p.matrix @ (q / qn if qn > 0 else q)
    inner = ((2.0 * bits - 1.0) @ o) / np.sqrt(len(o))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = qn * qn + norm * norm - 2 * qn * norm * inner / corr
    return np.where(corr < 1e-8, np.inf, d)


def encoded(entries: DataFrame, p: Params) -> DataFrame:
    """Adds ``code`` (BINARY), ``code_norm`` and ``code_corr``; null for vectors of another dimension."""
    sent = entries.sparkSession.sparkContext.broadcast(p)

    @F.pandas_udf("code binary, code_norm double, code_corr double")
    def work(col: pd.Series) -> pd.DataFrame:
        p = sent.value
        ok = col.map(lambda v: v is not None and len(v) == len(p.centroid)).to_numpy(bool)
        out = pd.DataFrame({"code": pd.Series([None] * len(col), dtype=object), "code_norm": np.nan, "code_corr": np.nan})
        if ok.any():
            bits, norm, corr = encode(np.stack(col[ok].to_numpy()), p)
            out.loc[ok, "code"] = pd.Series([b.tobytes() for b in np.packbits(bits, axis=1)], index=out.index[ok], dtype=object)
            out.loc[ok, "code_norm"], out.loc[ok, "code_corr"] = norm, corr
        return out

    return entries.withColumn("c", work("vector")).select(*entries.columns, "c.code", "c.code_norm", "c.code_corr")


def with_estimate(codes: DataFrame, query: list[float], p: Params) -> DataFrame:
    """Adds the estimated ``score`` of (key, code, code_norm, code_corr).

    For cosine it is (cos + 1) / 2 with the estimated cosine, which is not the scale of exact scores; for l2 it is 1 / (1 + distance).
    """
    sent = codes.sparkSession.sparkContext.broadcast((p, np.asarray(query, np.float64)))

    @F.pandas_udf("double")
    def distance(code: pd.Series, norm: pd.Series, corr: pd.Series) -> pd.Series:
        p, q = sent.value
        bits = np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1), axis=1)[:, : len(q)]
        return pd.Series(estimate(bits, norm.to_numpy(), corr.to_numpy(), q, p))

    d = codes.withColumn("d", distance("code", "code_norm", "code_corr"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("d") / 2))
    score = (cos + 1) / 2 if p.metric == "cosine" else 1 / (1 + F.greatest("d", F.lit(0.0)))
    return d.withColumn("score", score).drop("d")


def estimated_search(codes: DataFrame, query: list[float], p: Params, k: int) -> DataFrame:
    """(key, score): the k entries (key, code, code_norm, code_corr) with the greatest estimated score (``with_estimate``), to 6 digits."""
    d = with_estimate(codes.filter("code is not null"), query, p)
    return d.select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(k)


def estimated_rerank(entries: DataFrame, codes: DataFrame, query: list[float], p: Params, k: int, oversample: int = 20) -> DataFrame:
    """The k best by exact similarity among the best ``oversample`` * k by estimate."""
    from karst.operators.search import search

    best = estimated_search(codes, query, p, k * oversample).select("key")
    return search(entries.join(best, "key", "left_semi"), query, k, ns="", metric=p.metric)
