"""A change feed applied to a table by delete vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.runtime import new_path

FIRST = -(2**63)
IMAGE = "key string, value string, lsn long, ts long, worm boolean, dead boolean"


def record_kind(c: Column) -> Column:
    """set, delete, vinsert or vdelete, however the type is spelled; null for anything else."""
    x = F.lower(F.trim(c))
    x = F.when(x == "del", "delete").otherwise(x)
    return F.when(x.isin("set", "delete", "vinsert", "vdelete"), x)


def winners(records: DataFrame) -> DataFrame:
    """One record per key: the earliest write-once set if there is one, else the latest record by (ts, lsn).

    Both are associative, so repeats and late records change nothing, and partial aggregation runs before the shuffle:
    a key with a third of all rows costs one row per task.
    """
    image = F.struct("ts", "lsn", "value", "dead")
    worm = F.min(F.when(F.col("worm"), image))
    last = F.max(F.when(~F.col("worm"), image))
    d = records.groupBy("key").agg(worm.alias("w"), last.alias("l"))
    x = F.coalesce("w", "l")
    return d.select("key", x["value"].alias("value"), x["lsn"].alias("lsn"), x["ts"].alias("ts"), F.col("w").isNotNull().alias("worm"), x["dead"].alias("dead"))


def supersedes(n: str, o: str) -> Column:
    """Whether record ``n`` takes the place of ``o``."""
    a, b = F.struct(f"{n}.ts", f"{n}.lsn"), F.struct(f"{o}.ts", f"{o}.lsn")
    nw, ow = F.col(f"{n}.worm"), F.col(f"{o}.worm")
    return F.when(nw & ow, a < b).when(nw, True).when(ow, False).otherwise(a > b)


OLD = "old_file string, old_part long, old_bit long"  # stored beside each image: the position of the row it supersedes
INDEX = "key string, ts long, lsn long, worm boolean, file string, part long, bit long, version int"


class DeleteVectorTable:
    """A keyed table in immutable files with a bitmap per file of the rows that no longer hold.

    ``apply`` looks up the current row of each changed key in a stored index (key to file and position, in ``buckets`` hash buckets, one
    folder each), reading only the buckets of changed keys; it sets the bits of superseded positions and appends the new images and their
    index rows. Nothing is rewritten, and no image is read. ``live`` and ``read`` filter positions whose bit is set. Deletes
    are images, too (``dead``), so that a late older set can't bring a key back. A bitmap covers 32,768 positions of a file.
    Each ``apply`` writes below ``path``/v<n>; what is not yet listed here is not read, so a failed apply leaves no trace. After ``merge_at`` of
    them the index and the bitmaps are merged (``merge``); ``rewrite`` also drops superseded images.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32, merge_at: int = 16):
        self.spark, self.path, self.buckets, self.merge_at = spark, path or new_path(spark, "changes"), buckets, merge_at
        self.versions = 0
        self.image_parts: list[str] = []
        self.index_parts: list[str] = []
        self.bits_parts: list[str] = []

    def _bucket(self, key: str = "key") -> Column:
        return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(self.buckets)).cast("int")

    def _images(self, parts: list[str] | None = None, schema: str = IMAGE) -> DataFrame:
        """Images, all or of some parts, with file and position."""
        d = self.spark.read.schema(schema).parquet(*(parts or self.image_parts))
        at = F.col("_metadata.row_index")
        return d.select("*", F.col("_metadata.file_path").alias("file"), F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit"))

    def _bitmaps(self) -> DataFrame:
        d = self.spark.read.schema("file string, part long, bits binary").parquet(*self.bits_parts)
        return d.groupBy("file", "part").agg(F.bitmap_or_agg("bits").alias("bits"))

    def index(self, buckets: list[int] | None = None) -> DataFrame:
        """The current position of each key, of some buckets: of several index rows of a key the one of the latest version counts."""
        d = None
        for part in self.index_parts:
            x = self.spark.read.schema(f"{INDEX}, bucket int").parquet(part)
            d = x if d is None else d.unionByName(x)
        if buckets is not None:
            d = d.filter(F.col("bucket").isin(buckets))
        row = F.struct("version", "ts", "lsn", "worm", "file", "part", "bit")
        return d.groupBy("bucket", "key").agg(F.max_by(row, "version").alias("r")).select("bucket", "key", "r.*")

    def live(self) -> DataFrame | None:
        """Images whose bit is not set, with file and position."""
        if not self.versions:
            return None
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")), F.lit(0))
        return self._images().join(self._bitmaps(), ["file", "part"], "left").filter(is_set == 0).drop("bits")

    def apply(self, records: DataFrame) -> None:
        """Applies records (key, value, lsn, ts, worm, dead), in whatever order they come."""
        new, names = winners(records), [c.split()[0] for c in IMAGE.split(", ")]
        out = f"{self.path}/v{self.versions}"
        none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in OLD.split(", ")]
        if not self.versions:
            images = new.select(*names, *none)
        else:
            # Written once, so that the feed is read once; the numbers of touched buckets are all that reaches the driver.
            new.withColumn("bucket", self._bucket()).write.parquet(f"{out}/changes")
            new = self.spark.read.schema(f"{IMAGE}, bucket int").parquet(f"{out}/changes")
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
            both = new.alias("n").join(self.index(touched).alias("o"), (F.col("n.bucket") == F.col("o.bucket")) & (F.col("n.key") == F.col("o.key")), "left")
            both = both.filter(F.col("o.key").isNull() | supersedes("n", "o"))
            images = both.select(*[f"n.{c}" for c in names], F.col("o.file").alias("old_file"), F.col("o.part").alias("old_part"), F.col("o.bit").alias("old_bit"))
        images.write.parquet(f"{out}/images")
        old = self.spark.read.schema(OLD).parquet(f"{out}/images").filter("old_file is not null")
        old.groupBy(F.col("old_file").alias("file"), F.col("old_part").alias("part")).agg(F.bitmap_construct_agg(F.col("old_bit")).alias("bits")).write.parquet(f"{out}/bits")
        self._write_index(self._images([f"{out}/images"], "key string, ts long, lsn long, worm boolean"), f"{out}/index")
        self.image_parts.append(f"{out}/images")
        self.index_parts.append(f"{out}/index")
        self.bits_parts.append(f"{out}/bits")
        self.versions += 1
        if len(self.index_parts) > self.merge_at:
            self.merge()

    def _write_index(self, rows: DataFrame, path: str) -> None:
        d = rows.select("key", "ts", "lsn", "worm", "file", "part", "bit", F.lit(self.versions).alias("version"), self._bucket().alias("bucket"))
        d.repartition("bucket").write.partitionBy("bucket").parquet(path)

    def merge(self) -> None:
        """Merges the parts of the index and of the bitmaps into one each; images stay where they are."""
        out = f"{self.path}/m{self.versions}"
        self.index().select(*[c.split()[0] for c in INDEX.split(", ")], "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{out}/index")
        self._bitmaps().write.parquet(f"{out}/bits")
        self.index_parts, self.bits_parts = [f"{out}/index"], [f"{out}/bits"]

    def rewrite(self) -> None:
        """Writes the live images anew, in order of key, with an index of their own and no bits."""
        live = self.live()
        if live is None:
            return
        out = f"{self.path}/v{self.versions}"
        names = [c.split()[0] for c in IMAGE.split(", ")]
        live.select(*names).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{out}/images")
        self.spark.createDataFrame([], "file string, part long, bits binary").write.parquet(f"{out}/bits")
        self._write_index(self._images([f"{out}/images"], "key string, ts long, lsn long, worm boolean"), f"{out}/index")
        self.image_parts, self.index_parts, self.bits_parts = [f"{out}/images"], [f"{out}/index"], [f"{out}/bits"]
        self.versions += 1

    def read(self) -> DataFrame:
        """(key, value, lsn, ts, worm) of the live keys."""
        d = self.live()
        if d is None:
            d = self.spark.createDataFrame([], IMAGE)
        return d.filter(~F.col("dead")).select("key", "value", "lsn", "ts", "worm")


def key_records(feed: DataFrame) -> DataFrame:
    """The sets and deletes of a feed as typed records.

    A null key or an unknown type is ignored; a null value of a set is empty; a null ``is_worm`` is false; a null
    timestamp or lsn counts as the smallest.
    """
    kind = record_kind(F.col("record_type"))
    return feed.select(
        "key",
        F.when(kind == "set", F.coalesce("value", F.lit(""))).alias("value"),
        F.coalesce(F.col("lsn").cast("long"), F.lit(FIRST)).alias("lsn"),
        F.coalesce(F.col("timestamp").cast("long"), F.lit(FIRST)).alias("ts"),
        ((kind == "set") & F.coalesce(F.col("is_worm"), F.lit(False))).alias("worm"),
        (kind == "delete").alias("dead"),
    ).filter(kind.isin("set", "delete") & F.col("key").isNotNull())


def replay(feed: DataFrame, batches: int = 4, arrival: str = "arrival_no", path: str | None = None) -> DataFrame:
    """The live keys after the whole feed: (key, value, lsn, ts, worm).

    The feed is applied in ``batches`` equal ranges of ``arrival`` (a null arrival in the first), each by one ``apply``.
    The result doesn't depend on their number. An empty feed gives an empty table.
    """
    spark = feed.sparkSession
    table = DeleteVectorTable(spark, path)
    lo, hi = feed.agg(F.min(arrival), F.max(arrival)).first()
    step = max(1, -(-((hi or 0) - (lo or 0) + 1) // batches))
    at = F.col(arrival)
    for b in range(batches):
        # As a range, which reaches the scan: files and row groups of other batches aren't read.
        begin, end = (lo or 0) + b * step, (lo or 0) + (b + 1) * step
        here = (at < end) | at.isNull() if b == 0 else (at >= begin) & (at < end)
        table.apply(key_records(feed.filter(here)))
    return table.read()
