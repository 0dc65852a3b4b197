"""Overlapping and gapped intervals per entity: continuous periods, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.ranks import global_rank
from karst.runtime import written

DAY_MS = 86_400_000
NEVER = 2**63 - 1


def org_hex(c: Column) -> Column:
    """An organisation id as 64 lower-case hex digits; null where it isn't one."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s:_-]", ""), "^0x", "")
    return F.when(x.rlike("^[0-9a-f]{64}$"), x)


def coalesce_intervals(df: DataFrame, keys: list[str], start: str, end: str, bucket_ms: int = DAY_MS) -> DataFrame:
    """Periods and gaps of the half-open intervals [start, end) of each ``keys``: (*keys, kind, start_ms, end_ms).

    Starts and ends are sorted independently per entity; where the start of rank i + 1 exceeds the end of rank i, every
    interval begun so far is over, so a gap lies between the two. The k-th period is bounded by the k-th start after a
    gap and the k-th end before one. An ``end`` of ``NEVER`` is open and comes out as 0.

    Rows with a null key, start or end, or with an end not after the start, are ignored. Intervals that touch belong to
    one period; repeated rows and ties change nothing; an empty table gives an empty result. Other columns are not
    looked at, so they may have any name.

    Of intervals with the same start only the longest is kept, and then of those with the same end: their union stays
    the same, while repeats vanish before the shuffle. Ranks are taken by day and entity, so no entity is held by one task.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    for k in ks:
        rows = rows.filter(F.col(k).isNotNull())
    rows = rows.filter(F.col("e") > F.col("s"))
    rows = written(rows.groupBy(*ks, "s").agg(F.max("e").alias("e")).groupBy(*ks, "e").agg(F.min("s").alias("s")), "intervals")

    day = lambda t: F.floor(F.col(t) / F.lit(bucket_ms))

    def ranked(d: DataFrame, t: str) -> DataFrame:
        return global_rank(d.select(*ks, F.col(t).alias("t")), ks, day("t"), ["t"])

    s, e = ranked(rows, "s"), ranked(rows, "e")
    none = F.lit(None).cast("long")
    # The row of rank i has the end of rank i and the start of rank i + 1; rank 0 has the first start, the last rank no start.
    edges = s.select(*ks, (F.col("rank") - 1).alias("rank"), F.col("t").alias("next_s"), none.alias("e")).unionByName(e.select(*ks, "rank", none.alias("next_s"), F.col("t").alias("e")))
    edges = edges.groupBy(*ks, "rank").agg(F.max("next_s").alias("next_s"), F.max("e").alias("e"))
    edges = written(edges.filter(F.col("next_s").isNull() | F.col("e").isNull() | (F.col("next_s") > F.col("e"))), "edges")

    begins = ranked(edges.filter("next_s is not null"), "next_s")
    ends = ranked(edges.filter("e is not null"), "e")
    spans = begins.select(*ks, "rank", F.col("t").alias("s"), none.alias("e")).unionByName(ends.select(*ks, "rank", none.alias("s"), F.col("t").alias("e")))
    periods = spans.groupBy(*ks, "rank").agg(F.max("s").alias("start_ms"), F.max("e").alias("end_ms")).select(*ks, F.lit("period").alias("kind"), "start_ms", F.when(F.col("end_ms") == NEVER, 0).otherwise(F.col("end_ms")).alias("end_ms"))
    gaps = edges.filter("next_s is not null and e is not null").select(*ks, F.lit("gap").alias("kind"), F.col("e").alias("start_ms"), F.col("next_s").alias("end_ms"))
    return periods.unionByName(gaps).select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "kind", "start_ms", "end_ms")


def trust_periods(trust: DataFrame) -> DataFrame:
    """Periods and gaps of trust of each (from_org, to_org), from the grant rows of a trust log."""
    exp = F.col("expires_at_ms")
    grants = trust.filter(F.lower(F.trim("kind")) == "grant").select(
        F.unhex(org_hex(F.col("from_org"))).alias("from_org"),  # half the bytes of the digits
        F.unhex(org_hex(F.col("to_org"))).alias("to_org"),
        F.col("granted_at_ms").alias("s"),
        F.when(exp.isNull() | (exp == 0), F.lit(NEVER)).otherwise(exp).alias("e"),
    )
    d = coalesce_intervals(grants, ["from_org", "to_org"], "s", "e")
    return d.withColumns({c: F.lower(F.hex(c)) for c in ("from_org", "to_org")})
