"""Plans are the ones wanted: filters and columns reach the scan, top-k is pruned before a shuffle, hot paths stay in the JVM."""

import re

import pytest
from pyspark.sql import functions as F

from karst.operators import changes, kv, log
from karst.plans import reference

JVM = ["vsearch_exact_cosine", "vsearch_decay", "mem_query_filtered", "mem_range", "scan_prefix_last", "overlay_merge", "chat_history_latest", "log_envelope_hash", "trust_fold", "hlc_assign", "sync_diff", "kv_counters", "predicate_columns", "longest_namespace"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM)
def test_no_python(spark, data, name):
    assert not re.search("Python|Pandas|Arrow", plan(reference.QUERIES[name](spark, data)))


@pytest.mark.parametrize("name", ["vsearch_exact_cosine", "mem_query_filtered", "mem_range", "scan_prefix_first", "scan_prefix_last"])
def test_bounded_sorts(spark, data, name):
    assert "TakeOrderedAndProject" in plan(reference.QUERIES[name](spark, data))


def test_prefix_reaches_the_scan(spark, data):
    p = plan(kv.prefix_scan(spark.read.parquet(f"{data}/wal.parquet"), "kv:").select("key"))
    assert "StringStartsWith(key,kv:)" in p and "ReadSchema: struct<key:string>" in p


def test_arrival_range_reaches_the_scan(spark, data):
    feed = spark.read.parquet(f"{data}/wal.parquet")
    p = plan(changes.winners(changes.key_records(feed.filter((F.col("arrival_no") >= 5) & (F.col("arrival_no") < 9)))))
    assert "GreaterThanOrEqual(arrival_no,5)" in p and "LessThan(arrival_no,9)" in p
    assert p.count("Exchange") == 1 and p.count("Aggregate") >= 2  # partial before the shuffle


def test_groups_are_pruned_before_the_shuffle(spark, data):
    p = plan(kv.chat_latest(spark.read.parquet(f"{data}/chat_history.parquet"), 5))
    assert p.count("WindowGroupLimit") == 2


def test_verification_is_no_window_over_a_whole_log(spark, data):
    p = plan(log.verify_chain(log.build_chain(reference.log_rows(spark, data))))
    assert "__bucket" in p
