"""Queries of the general training-data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from karst.operators.changes import replay
from karst.operators.intervals import trust_periods


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(spark.read.parquet(f"{d}/wal.parquet")).select("key", "lsn")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    return replay(spark.read.parquet(f"{d}/wal.parquet")).select("key", "value", "lsn", "worm")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return trust_periods(spark.read.parquet(f"{d}/trust_log.parquet"))


QUERIES = {"p3_found": p3_found, "p3_state": p3_state, "p5_found": p5_found}

_REPLAY = """
with r as (
  select key, lsn, coalesce(value, '') as value, "timestamp" as ts, lower(trim(record_type)) as t, coalesce(is_worm, false) as w
  from wal where key is not null),
s as (select key, lsn, value, ts, t in ('delete', 'del') as dead, t = 'set' and w as worm from r where t in ('set', 'delete', 'del')),
o as (select *, row_number() over (partition by key order by worm desc, case when worm then ts else -ts end, case when worm then lsn else -lsn end) as rn from s)
"""

_PERIODS = """
with g as (
  select regexp_replace(lower(trim(from_org)), '^0x', '') as from_org, regexp_replace(lower(trim(to_org)), '^0x', '') as to_org,
         granted_at_ms as s, case when coalesce(expires_at_ms, 0) = 0 then 9223372036854775807 else expires_at_ms end as e
  from trust_log where kind = 'grant' and from_org is not null and to_org is not null and granted_at_ms is not null),
v as (select distinct from_org, to_org, s, e from g where e > s),
m as (select *, max(e) over (partition by from_org, to_org order by s, e rows between unbounded preceding and 1 preceding) as before from v),
n as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by from_org, to_org order by s, e rows unbounded preceding) as k from m),
p as (select from_org, to_org, k, min(s) as s, max(e) as e from n group by 1, 2, 3)
select from_org, to_org, 'period' as kind, s as start_ms, case when e = 9223372036854775807 then 0 else e end as end_ms from p
union all
select a.from_org, a.to_org, 'gap', a.e, b.s from p a join p b on a.from_org = b.from_org and a.to_org = b.to_org and b.k = a.k + 1
"""

ORACLE = {
    "p3_found": _REPLAY + "select key, lsn from o where rn = 1 and not dead",
    "p3_state": _REPLAY + "select key, value, lsn, worm from o where rn = 1 and not dead",
    "p5_found": _PERIODS,
}
