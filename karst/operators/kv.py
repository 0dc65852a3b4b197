"""Key-value tables (S1-S9, S11, S12, K2-K5, K7, K8) of (key, value, ts_ms, is_worm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions.ranks import running


def get(kv: DataFrame, key: str) -> DataFrame:
    return kv.filter(F.col("key") == key)


def bulk_get(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) of each requested key, null where there is none."""
    return keys.select("key").distinct().join(kv.select("key", "value"), "key", "left")


def prefix_scan(kv: DataFrame, prefix: str = "", limit: int = 0, keep: str = "last", key: str = "key") -> DataFrame:
    """Rows whose key starts with ``prefix``, in order of key; of them the last (or first) ``limit``, 0 for all. The prefix is pushed to the scan.

    Null keys are left out. All rows are ordered by a range partitioning, a limit is taken in each task first.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    d = kv.filter(F.col(key).startswith(prefix)) if prefix else kv.filter(F.col(key).isNotNull())
    if limit:
        d = d.orderBy(F.col(key).desc() if keep == "last" else F.col(key)).limit(limit)
    return d.orderBy(key)


def scan(kv: DataFrame, prefix: str, limit: int = 100, keep: str = "last") -> DataFrame:
    """(k, v, ts): as ``prefix_scan`` with a limit of 100 where 0 is given and 1000 at most."""
    return prefix_scan(kv, prefix, min(limit or 100, 1000), keep).select(F.col("key").alias("k"), F.col("value").alias("v"), F.col("ts_ms").alias("ts"))


def prefix_count(kv: DataFrame, prefix: str) -> DataFrame:
    """(n): keys below the prefix; each once, whatever layers hold it."""
    return kv.filter(F.col("key").startswith(prefix)).agg(F.count_distinct("key").alias("n"))


def status(kv: DataFrame) -> DataFrame:
    """(keys, worm, bytes): entries, write-once ones among them, and the bytes of keys and values."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return kv.agg(F.count("key").alias("keys"), F.coalesce(F.sum(F.coalesce(F.col("is_worm"), F.lit(False)).cast("int")), F.lit(0)).alias("worm"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def entry_metadata(kv: DataFrame) -> DataFrame:
    """(key, ts_ms, is_worm, bytes, sha256)."""
    return kv.select("key", "ts_ms", "is_worm", F.octet_length("value").alias("bytes"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))


def overlay(layers: list[DataFrame], key: str = "key") -> DataFrame:
    """One row per key, that of the earliest layer which has the key; ``layer`` tells which. Partial aggregation runs before the shuffle."""
    d = None
    for i, x in enumerate(layers):
        x = x.withColumn("layer", F.lit(i))
        d = x if d is None else d.unionByName(x)
    rest = [c for c in layers[0].columns if c != key]
    row = F.struct(*rest, "layer")
    return d.groupBy(key).agg(F.min_by(row, F.struct("layer", *[F.col(c).cast("string") for c in rest])).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest], F.col("r.layer").alias("layer"))


def checked_writes(kv: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) writes: those of a write-once key are rejected, in whatever layer it is."""
    worm = kv.filter("is_worm").select("key").distinct()
    return writes.join(worm, "key", "left_anti"), writes.join(worm, "key", "left_semi")


def to_number(value: Column, default: int = 0) -> Column:
    """Decimal text as a number; anything else counts as absent."""
    return F.coalesce(value.try_cast("bigint"), F.lit(default))


def increments(ops: DataFrame) -> DataFrame:
    """Running value of each key after each operation (key, seq, delta): a delta that is no number is 1."""
    d = ops.select("key", "seq", to_number(F.col("delta"), 1).alias("d"))
    return running(d, ["key"], F.floor(F.col("seq") / 65_536), ["seq"], F.col("d"), "value").select("key", "seq", "value")


def counters(ops: DataFrame) -> DataFrame:
    """(key, created_ms, updated_ms, writes, reads) from operations (key, op put/get, ts_ms, seq): a put resets the reads; a get of a missing key counts nowhere."""
    put, got = F.col("op") == "put", F.col("op") == "get"
    ends = ops.groupBy("key").agg(F.max(F.when(put, F.col("seq"))).alias("last_put"), F.min(F.when(put, F.col("ts_ms"))).alias("created_ms"), F.max(F.when(put, F.col("ts_ms"))).alias("updated_ms"), F.sum(put.cast("int")).alias("writes"))
    ends = ends.filter("last_put is not null")
    reads = ops.filter(got).join(ends.select("key", "last_put"), "key").filter("seq > last_put").groupBy("key").agg(F.count(F.lit(1)).alias("reads"))
    return ends.join(reads, "key", "left").select("key", "created_ms", "updated_ms", "writes", F.coalesce("reads", F.lit(0)).alias("reads"))


def counter_totals(ops: DataFrame) -> DataFrame:
    """(reads, writes) over all operations."""
    count = lambda op: F.coalesce(F.sum((F.col("op") == op).cast("int")), F.lit(0)).alias
    return ops.agg(count("get")("reads"), count("put")("writes"))


def chat_latest(messages: DataFrame, limit: int = 50, room: str | None = None) -> DataFrame:
    """The last ``limit`` (0: 50, at most 200) messages of each room (or of one) by key, each key once, with their place, oldest first."""
    n = min(limit or 50, 200)
    d = messages if room is None else messages.filter(F.col("room") == room)
    d = d.dropDuplicates(["room", "key"])
    w = Window.partitionBy("room").orderBy(F.desc("key"))
    d = d.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)  # pruned in each task before the shuffle
    return d.withColumn("place", F.row_number().over(Window.partitionBy("room").orderBy("key"))).drop("back")
