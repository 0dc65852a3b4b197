"""Change feeds by delete vectors against applying the records one by one."""

import random

import pytest
from pyspark.sql import functions as F

from karst.operators.changes import DeleteVectorTable, key_records, record_kind, replay, winners

SCHEMA = "arrival_no long, lsn long, record_type string, key string, value string, is_worm boolean, timestamp long, lsn2 long, file string"


def by_hand(rows):
    state, frozen = {}, set()
    for r in sorted({(x[6] if x[6] is not None else -(2**63), x[1], *x[2:6]) for x in rows}, key=lambda x: (x[0], x[1])):
        ts, lsn, kind, key, value, worm = r
        kind = {"del": "delete"}.get((kind or "").strip().lower(), (kind or "").strip().lower())
        if key is None or key in frozen or kind not in ("set", "delete"):
            continue
        if kind == "delete":
            state.pop(key, None)
        else:
            state[key] = (value or "", lsn)
            if worm:
                frozen.add(key)
    return state


def feed(seed, n, keys):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if r.random() < 0.3 else r.choice([*[f"k{j}" for j in range(keys)], None])
        kind = r.choice(["set", " SET", "set", "Delete", "DEL", "vinsert", "vdelete ", None, "other"])
        rows.append((0, i, kind, key, r.choice(["a", "b", "", None]), r.choice([True, False, None, None, None]) if r.random() < 0.2 else None, r.choice([None, *range(40)]) if r.random() < 0.9 else 5, i, "x"))
    again = [r.choice(rows) for _ in range(n // 4)]
    rows += again
    r.shuffle(rows)
    return [(i, *x[1:]) for i, x in enumerate(rows)]


@pytest.mark.parametrize(("seed", "batches"), [(1, 1), (2, 3), (3, 5)])
def test_replay_is_the_same_in_any_batches(spark, seed, batches):
    rows = feed(seed, 160, 12)
    got = {r.key: (r.value, r.lsn) for r in replay(spark.createDataFrame(rows, SCHEMA), batches).collect()}
    assert got == by_hand(rows)


def test_empty_feed(spark):
    assert replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_arrival_is_applied(spark):
    rows = [(None, 1, "set", "a", "x", None, 1, 0, ""), (7, 2, "set", "b", None, None, 2, 0, "")]
    assert {(r.key, r.value) for r in replay(spark.createDataFrame(rows, SCHEMA), 2).collect()} == {("a", "x"), ("b", "")}


def test_positions_are_marked_not_rewritten(spark, tmp_path):
    t = DeleteVectorTable(spark, str(tmp_path))
    first = spark.createDataFrame([(0, i, "set", f"k{i}", "old", None, 1, 0, "") for i in range(50)], SCHEMA)
    t.apply(key_records(first))
    t.apply(key_records(spark.createDataFrame([(0, 99, "set", "k7", "new", None, 5, 0, ""), (0, 98, "delete", "k8", None, None, 5, 0, "")], SCHEMA)))
    assert t._images().count() == 52 and t.live().count() == 50 and t._bitmaps().count() >= 1
    state = {r.key: r.value for r in t.read().collect()}
    assert len(state) == 49 and state["k7"] == "new" and "k8" not in state
    # A late older set neither comes back nor adds an image.
    t.apply(key_records(spark.createDataFrame([(0, 50, "set", "k8", "late", None, 3, 0, "")], SCHEMA)))
    assert "k8" not in {r.key for r in t.read().collect()} and t._images().count() == 52


def test_long_values_and_winner_of_a_hot_key(spark):
    big = "x" * 300_000
    d = spark.createDataFrame([(0, i, "set", "hot", big if i == 500 else "s", None, i, 0, "") for i in range(501)], SCHEMA)
    w = winners(key_records(d)).collect()
    assert len(w) == 1 and w[0].value == big


def test_spelling(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(" DEL ",), ("vInsert",), (None,), ("x",)], "t string").select(record_kind(F.col("t")).alias("k"))
    assert [r.k for r in d.collect()] == ["delete", "vinsert", None, None]


def scanned(df) -> int:
    """Rows that a collected query has read from files."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            found += p.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            c = p.children()
            todo += [c.apply(i) for i in range(c.size())]
    return found


def test_a_small_batch_reads_only_its_buckets(spark, tmp_path):
    t = DeleteVectorTable(spark, str(tmp_path), buckets=400)
    record = lambda d: d.select(F.concat(F.lit("k"), "id").alias("key"), F.lit("v").alias("value"), F.col("id").alias("lsn"), F.col("id").alias("ts"), F.lit(False).alias("worm"), F.lit(False).alias("dead"))
    t.apply(record(spark.range(20_000)).coalesce(1))
    t.apply(record(spark.range(20_000, 20_004)).unionByName(record(spark.range(5)).withColumn("ts", F.lit(99_999).cast("long"))))
    buckets = [r.bucket for r in spark.read.parquet(f"{tmp_path}/v1/changes").select("bucket").distinct().collect()]
    assert len(buckets) <= 9 and scanned(t.index(buckets)) < 1_000  # of 20,009 index rows
    assert t.read().count() == 20_004 and t._bitmaps().selectExpr("sum(bitmap_count(bits)) as n").first().n == 5


def test_merged_and_rewritten_tables_are_the_same(spark, tmp_path):
    rows = feed(9, 200, 15)
    t = DeleteVectorTable(spark, str(tmp_path), buckets=4, merge_at=2)
    for i in range(0, len(rows), 50):
        t.apply(key_records(spark.createDataFrame(rows[i : i + 50], SCHEMA)))
    assert len(t.index_parts) <= 2
    want = by_hand(rows)
    assert {r.key: (r.value, r.lsn) for r in t.read().collect()} == want
    t.rewrite()
    assert {r.key: (r.value, r.lsn) for r in t.read().collect()} == want and t._images().count() == t.live().count()
    t.apply(key_records(spark.createDataFrame(rows[:50], SCHEMA)))  # repeated records change nothing
    assert {r.key: (r.value, r.lsn) for r in t.read().collect()} == want
