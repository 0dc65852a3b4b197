"""Tables on disk: sorted segments, versioned snapshots, and a catalog of named tables (S6-S16, D23, §2.15 persistence)."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.operators.changes import replay
from karst.operators.kv import bulk_get, checked_writes, overlay, status
from karst.runtime import ship, written

KV = "key string, value string, ts_ms long, is_worm boolean"


def write_segment(df: DataFrame, path: str, key: str | list[str] = "key", parts: int | None = None) -> None:
    """A read-only table sorted by key over all its files, so that prefix and point filters skip row groups."""
    keys = [key] if isinstance(key, str) else key
    d = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    d.sortWithinPartitions(*keys).write.parquet(path)


def read_segment(spark: SparkSession, path: str, schema: str = KV) -> DataFrame:
    """S10."""
    return spark.read.schema(schema).parquet(path)


def segment_lookup(segment: DataFrame, wanted: DataFrame) -> DataFrame:
    """(table_id, key, payload) for each of ``wanted`` (table_id, key), null where there is none; ids outside 0 to 31 are an error."""
    checked = F.when(F.col("table_id").between(0, 31), F.col("table_id")).otherwise(F.raise_error(F.lit("table_id outside 0 to 31")))
    return wanted.withColumn("table_id", checked).distinct().join(segment.select("table_id", "key", "payload"), ["table_id", "key"], "left")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_snapshot(df: DataFrame, root: str, key: str = "key", now_ms: int | None = None) -> int:
    """A snapshot below ``root``/v<time>; it counts once its marker is written, after the data, so a reader never sees half of one."""
    version = int(time.time() * 1000) if now_ms is None else now_ms
    write_segment(df, f"{root}/v{version}/data", key)
    p, fs = _fs(df.sparkSession, f"{root}/v{version}/_DONE")
    fs.create(p, True).close()
    return version


def snapshot_versions(spark: SparkSession, root: str) -> list[int]:
    p, fs = _fs(spark, root)
    if not fs.exists(p):
        return []
    jvm = spark.sparkContext._jvm
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName()[:1] == "v"]
    return sorted(int(x.getName()[1:]) for x in found if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_DONE")))


def read_snapshot(spark: SparkSession, root: str, schema: str = KV, version: int | None = None) -> DataFrame:
    """The newest complete snapshot, or that of ``version``; an empty table where there is none."""
    versions = snapshot_versions(spark, root)
    if version is None and not versions:
        return spark.createDataFrame([], schema)
    return read_segment(spark, f"{root}/v{version if version is not None else versions[-1]}/data", schema)


def compact(snapshot: DataFrame, feed: DataFrame) -> DataFrame:
    """The table after a feed (arrival_no, lsn, record_type, key, value, is_worm, timestamp) on top of a snapshot, which counts as older."""
    base = snapshot.select(
        F.lit(-1).cast("long").alias("arrival_no"), F.lit(-1).cast("long").alias("lsn"), F.lit("set").alias("record_type"), "key", "value", "is_worm", F.col("ts_ms").alias("timestamp"),
    )
    d = replay(base.unionByName(feed.select(base.columns)))
    return d.select("key", "value", F.col("ts").alias("ts_ms"), F.col("worm").alias("is_worm"))


@dataclass
class Catalog:
    """Named tables. ``layers`` of a table are read as one, the first that has a key counting (live rows before frozen segments)."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    layers: dict[str, list[DataFrame]] = field(default_factory=dict)
    configs: dict[str, object] = field(default_factory=dict)
    durable: bool = True

    def __post_init__(self) -> None:
        ship(self.spark)

    def read(self, name: str, schema: str = KV) -> DataFrame:
        d = self.tables.get(name)
        if name in self.layers:
            return overlay([*([d] if d is not None else []), *self.layers[name]]).drop("layer")
        return d if d is not None else self.spark.createDataFrame([], schema)

    def mount(self, name: str, segment: DataFrame) -> None:
        self.layers.setdefault(name, []).append(segment)

    def put(self, name: str, df: DataFrame) -> None:
        """Replaces a table; it is written at once (unless ``durable`` is off), so what comes later doesn't work it out again."""
        self.tables[name] = written(df, "table") if self.durable else df

    # -- the key-value table, as commands ------------------------------------------------------------------------------

    def set(self, rows: DataFrame, name: str = "kv") -> DataFrame:
        """Writes rows (key, value, ts_ms, is_worm) whose key isn't write-once; gives (key, outcome): written or worm."""
        old = self.read(name)
        ok, bad = checked_writes(old, rows)
        out = written(ok.select("key", F.lit("written").alias("outcome")).unionByName(bad.select("key", F.lit("worm").alias("outcome"))), "outcome")
        self.put(name, old.join(ok.select("key"), "key", "left_anti").unionByName(ok.select(old.columns)))
        return out

    def get(self, keys: DataFrame, name: str = "kv") -> DataFrame:
        """(key, value) of each of ``keys`` (key), null where there is none."""
        return bulk_get(self.read(name), keys)

    def delete(self, keys: DataFrame, name: str = "kv") -> DataFrame:
        """Removes ``keys`` (key) that aren't write-once; gives (key, outcome): deleted, worm or missing."""
        old = self.read(name)
        there = keys.select("key").distinct().join(old.groupBy("key").agg(F.bool_or(F.coalesce("is_worm", F.lit(False))).alias("worm")), "key", "left")
        out = written(there.select("key", F.when(F.col("worm").isNull(), "missing").when(F.col("worm"), "worm").otherwise("deleted").alias("outcome")), "outcome")
        self.put(name, old.join(out.filter("outcome = 'deleted'"), "key", "left_anti"))
        return out

    def status(self, name: str = "kv") -> DataFrame:
        return status(self.read(name))

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows, which alone are written."""
        new = written(df, "rows") if self.durable else df
        self.tables[name] = new if name not in self.tables else self.tables[name].unionByName(new)
