"""Vector tables: current usable entries, and their shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.runtime import written

SHARD_ROWS = 32_768  # most rows of a shard that is planned; a shard is one task
SHARD_FLOATS = 32_768 * 128  # most elements of a shard; longer vectors have fewer rows
FIT_ROWS = 4_096  # rows of a namespace on which its pivots are fitted (those with the smallest key hashes)
PROBES = 4  # shards a query visits in a namespace of several
SMALL = 100_000  # rows up to which a table of one row per namespace or group of copies is broadcast
PIVOT_BYTES = 64 << 20  # pivots of all namespaces up to which they are broadcast; beyond, they are joined by namespace
TASK = "ns string, cell int, sub int, key string, h long, home boolean, vector array<float>"


def namespace(key: Column) -> Column:
    """The key up to and including its last colon; empty where there is none."""
    return F.regexp_extract(key, r"(?s)^(.*:)", 1)


def order_hash(key: Column) -> Column:
    """The first 60 bits of a key's SHA-256: an order that any other system can make, too."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")


def near(df: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """A join that broadcasts ``small`` where its counted rows are few, and leaves it to the planner beyond."""
    return df.join(F.broadcast(small) if rows <= SMALL else small, on, how)


def current_entries(df: DataFrame, key: str = "key", ts: str = "ts_ms", vector: str = "vector", keep: Column | None = None) -> DataFrame:
    """(ns, key, vector) of the record of each key with the greatest ``ts``, where ``keep`` of that record holds.

    Of records with equal times the one with the greatest vector counts; a null time is the smallest; null keys are
    left out. Only rows with the vector length most usual in their namespace remain (of equally usual ones the
    smallest). What is not finite or has norm 0 is left to the shards, which see each vector anyway.
    """
    k = keep if keep is not None else F.lit(True)
    d = df.select(F.col(key).alias("key"), F.struct(F.col(ts).cast("long").alias("t"), F.col(vector).cast("array<float>").alias("v"), k.alias("k")).alias("r")).filter("key is not null")
    d = d.groupBy("key").agg(F.max("r").alias("r")).filter("r.k and size(r.v) > 0")
    d = written(d.select(namespace(F.col("key")).alias("ns"), "key", F.col("r.v").alias("vector")), "current")
    sizes = d.groupBy("ns", F.size("vector").alias("dim")).count()
    usual = written(sizes.groupBy("ns").agg(F.max(F.struct(F.col("count").alias("n"), (-F.col("dim")).alias("d"))).alias("m")).select("ns", (-F.col("m.d")).alias("dim"), F.col("m.n").alias("n")).coalesce(1), "usual")
    return near(d, usual, ["ns"], usual.count()).filter(F.size("vector") == F.col("dim")).select("ns", "key", "vector", "n")


def row_limit(shard_rows: int) -> Column:
    """Most rows of a shard, by the length of a row's vector."""
    return F.least(F.lit(shard_rows), F.greatest(F.lit(64), F.floor(F.lit(SHARD_FLOATS) / F.size("vector")))).cast("long")


@dataclass
class Shards:
    """Rows of ``TASK`` of namespaces with one shard (final by themselves) and of those with several (to be merged)."""

    single: DataFrame
    several: DataFrame | None


def to_matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 1), np.float32)


def by_length(col: pa.Array):
    """Row numbers and matrix of the vectors of each length; a batch may hold several namespaces."""
    n = col.value_lengths().to_numpy(zero_copy_only=False)
    for one in np.unique(n):
        at = np.flatnonzero(n == one)
        yield at, to_matrix(col.take(pa.array(at)) if len(at) < len(n) else col)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows as float64 unit vectors, and which of them are usable: finite, with a norm above 0."""
    x = x.astype(np.float64)
    ok = np.isfinite(x).all(1)
    top = np.abs(np.where(ok[:, None], x, 0)).max(1, initial=0)
    ok &= top > 0
    x = np.where(ok[:, None], x, 0) / np.where(ok, top, 1)[:, None]  # scaled first: squares of tiny elements would vanish
    return x / np.where(ok, np.sqrt((x * x).sum(1)), 1)[:, None], ok


def fit_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Centres of a spherical k-means over the sample."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(8):
        of = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, of, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 0, s / np.where(n > 0, n, 1), c)
    return c


def _assigned(rows: DataFrame, fitted: DataFrame, nearest, schema: str) -> DataFrame:
    """``rows`` with the cells of each, by pivots that are broadcast."""
    found: dict[str, list] = {}
    for r in sorted(fitted.collect(), key=lambda r: r.no):  # at most PIVOT_BYTES
        found.setdefault(r.ns, []).append(r.pivot)
    pivots = rows.sparkSession.sparkContext.broadcast({k: np.array(v, np.float32) for k, v in found.items()})

    def assign(batches):
        for b in batches:
            ns = np.array(b["ns"].to_pylist(), object)
            cells: list = [None] * len(ns)
            for one in set(ns):
                at = np.flatnonzero(ns == one)
                for i, c in zip(at, nearest(b["vector"].take(pa.array(at)), pivots.value[one])):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    return rows.mapInArrow(assign, schema)


def shards(rows: DataFrame, shard_rows: int = SHARD_ROWS, probes: int = PROBES) -> Shards:
    """Spreads (ns, key, vector, n) over shards; ``n`` is the row count of the namespace.

    A namespace of up to ``shard_rows`` (fewer of long vectors, ``row_limit``) is one shard. A larger one is cut into cells around pivots fitted on at most about
    ``FIT_ROWS`` of its rows; each row is indexed in its nearest cell (``home``) and is a query there and in the next
    ``probes`` - 1. A cell that comes out larger than ``shard_rows`` is split by hash, and a query visits all its parts.
    The pivots (one per shard_rows / 2 rows) are broadcast where all of them together are small, else rows and pivots of a namespace meet in groups of bounded size.
    """
    h = order_hash(F.col("key")).alias("h")
    limit = row_limit(shard_rows)
    single = rows.filter(F.col("n") <= limit).select("ns", F.lit(0).alias("cell"), F.lit(0).alias("sub"), "key", h, F.lit(True).alias("home"), "vector")
    large = rows.filter(F.col("n") > limit)
    counts = large.groupBy("ns").agg(F.first("n").alias("n"), F.min(limit).alias("most")).collect()  # at most all rows / shard_rows
    if not counts:
        return Shards(single, None)

    want = {r.ns: -(-r.n * 2 // r.most) for r in counts}

    def fit(t: pa.Table) -> pa.Table:
        x, ok = unit(to_matrix(t["vector"]))
        ns = t["ns"][0].as_py()
        c = fit_pivots(x[ok], want[ns]) if ok.any() else np.eye(1, x.shape[1])
        return pa.table({"ns": pa.array([ns] * len(c)), "no": pa.array(range(len(c)), pa.int32()), "pivot": pa.array(list(c.astype(np.float32)), pa.list_(pa.float32()))})

    sample = large.filter(F.pmod(F.xxhash64("key", F.lit(3)), F.col("n")) < FIT_ROWS)
    fitted = written(sample.groupBy("ns").applyInArrow(fit, "ns string, no int, pivot array<float>"), "pivots")
    weight = fitted.agg(F.sum(F.size("pivot") * 4)).first()[0] or 0
    large = large.select("ns", "key", h, "vector", "n")
    schema = "ns string, key string, h long, vector array<float>, cells array<int>"

    def nearest(vectors: pa.Array, pivots: np.ndarray) -> np.ndarray:
        x, _ = unit(to_matrix(vectors))
        return np.argsort(-(x.astype(np.float32) @ pivots.T), axis=1, kind="stable")[:, :probes].astype(np.int32)

    def meet(t: pa.Table, p: pa.Table) -> pa.Table:
        cells = nearest(t["vector"], to_matrix(p.sort_by("no")["pivot"])) if len(t) else []
        return pa.table({"ns": t["ns"], "key": t["key"], "h": t["h"], "vector": t["vector"], "cells": pa.array(list(cells), pa.list_(pa.int32()))})

    if weight > PIVOT_BYTES:
        parts = F.ceil(F.col("n") / shard_rows).cast("int")
        left = large.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(9)), parts).cast("int"))
        salts = large.groupBy("ns").agg(F.explode(F.sequence(F.lit(0), F.first(parts) - 1)).alias("salt"))
        right = fitted.join(salts, "ns")
        assigned = left.groupBy("ns", "salt").cogroup(right.groupBy("ns", "salt")).applyInArrow(meet, schema)
    else:
        assigned = _assigned(large.drop("n"), fitted, nearest, schema)
    d = written(assigned, "assigned")
    size = written(d.groupBy("ns", F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(limit).alias("most")).select("ns", "cell", F.ceil(F.col("n") / F.col("most")).cast("int").alias("subs")).coalesce(1), "cells")
    d = near(d.select("ns", "key", "h", "vector", F.posexplode("cells").alias("at", "cell")), size, ["ns", "cell"], size.count())
    mine = F.pmod(F.xxhash64("vector"), F.col("subs")).cast("int")
    d = d.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    several = d.select("ns", "cell", "sub", "key", "h", ((F.col("at") == 0) & (F.col("sub") == mine)).alias("home"), "vector")
    return Shards(single, several)
