"""Ranks within a group that no single task has to hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], name: str = "rank") -> DataFrame:
    """1-based rank of each row within ``keys`` in the order (bucket, *order).

    The group is split by ``bucket``: rows are ranked within (keys, bucket), and a prefix sum over the bucket counts
    gives each bucket its offset, so a hot group is spread over as many tasks as it has buckets. ``keys`` and
    ``bucket`` may be null (null sorts first, as a group of its own).
    """
    b, r = "__bucket", "__r"
    df = df.withColumn(b, bucket)
    local = df.withColumn(r, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)))
    return _with_earlier(local, df, keys, F.count(F.lit(1)), F.sum, F.col(r) + F.coalesce(F.col("__earlier"), F.lit(0)), name, [r])


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], value: Column, name: str, largest: bool = False) -> DataFrame:
    """Running sum (or maximum, with ``largest``) of ``value`` within ``keys`` in the order (bucket, *order), split like ``global_rank``."""
    b, v, r = "__bucket", "__v", "__r"
    f = F.max if largest else F.sum
    df = df.withColumn(b, bucket).withColumn(v, value)
    here = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(r, f(v).over(here))
    both = F.greatest(r, "__earlier") if largest else F.when(F.col(r).isNull(), F.col("__earlier")).otherwise(F.col(r) + F.coalesce(F.col("__earlier"), F.lit(0)))
    return _with_earlier(local, df, keys, f(v), f, both, name, [v, r])


def previous(df: DataFrame, keys: list[str], bucket: Column, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Adds a struct of ``columns`` of the row before within ``keys`` in the order (bucket, *order), null for the first; split like ``global_rank``."""
    b, r, x = "__bucket", "__r", "__x"
    df = df.withColumn(b, bucket).withColumn(x, F.struct(*columns))
    w = Window.partitionBy(*keys, b).orderBy(*order)
    local = df.withColumn(r, F.lag(x).over(w))
    return _with_earlier(local, df, keys, F.max_by(x, F.struct(*order)), lambda c: F.last(c), F.coalesce(F.col(r), F.col("__earlier")), name, [x, r])


def _with_earlier(local: DataFrame, df: DataFrame, keys: list[str], per_bucket: Column, over: Callable, combined: Column, name: str, drop: list[str]) -> DataFrame:
    """``local`` with ``combined`` of its own columns and ``__earlier``, what ``over`` gives of the buckets before a row's."""
    b = "__bucket"
    buckets = df.groupBy(*keys, b).agg(per_bucket.alias("__p"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(b).alias("__b2"), over("__p").over(before).alias("__earlier"))
    on = local[b].eqNullSafe(buckets["__b2"])
    for i, k in enumerate(keys):
        on = on & local[k].eqNullSafe(buckets[f"__k{i}"])
    return local.join(buckets, on).withColumn(name, combined).select(*[local[c] for c in df.columns if c != b and c not in drop], name)
