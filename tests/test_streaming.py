"""Streams equal their batch form."""

from pyspark.sql import functions as F

from karst.operators import folds
from karst.streaming import bus
from test_folds import random_tasks


def test_publish_and_subscribe(spark, tmp_path):
    folder, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    m = spark.createDataFrame([("memory", '{"about":"user-x","v":1}', 1), ("memory", '{"about":"user-y"}', 2), ("other", '{"about":"user-x"}', 3), (None, None, None)], bus.MESSAGE)
    bus.publish(m, folder)
    s = bus.subscribe(spark, folder, "memory", 'meta.about="user-x"')
    assert bus.run_once(s, sink, state).count() == 1
    bus.publish(m.limit(1), folder)
    assert bus.run_once(bus.subscribe(spark, folder, "memory", 'meta.about="user-x"'), sink, state).count() == 2


def test_windows_close_with_the_watermark(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(e.schema).parquet(data + "/events.parque[t]")
    got = bus.run_once(bus.window_counts(stream, "ts", ["event_type"], "1 hour"), str(tmp_path / "o"), str(tmp_path / "s"))
    batch = bus.window_counts(e, "ts", ["event_type"], "1 hour")
    assert got.exceptAll(batch).count() == 0 and 0 < got.count() <= batch.count()


def test_task_stream(spark, tmp_path):
    rows = [r for r in random_tasks(5) if r["task"] and r["kind"] != "noise"]
    names = [c.split()[0] for c in folds.TASK_EVENT.split(", ")]
    d = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], folds.TASK_EVENT)
    for k, part in enumerate((d.filter("seq < 90"), d.filter("seq >= 90"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(folds.TASK_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = bus.task_states(stream, 1500).writeStream.outputMode("update").foreachBatch(lambda b, i: out.extend((i, r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.task: tuple(r) for _, r in sorted(out, key=lambda x: x[0])}
    assert last == {r.task: tuple(r) for r in folds.task_states(d, 1500).collect()}
    assert bus.progress(q)["batches"] >= 1


def test_sessions_and_duplicates(spark):
    d = spark.createDataFrame([("u", 0), ("u", 30), ("u", 5000), ("v", 0)], "u string, s long").select("u", F.timestamp_seconds("s").alias("t"))
    assert sorted((r.u, r.events) for r in bus.session_counts(d, "t", ["u"], "10 minutes").collect()) == [("u", 1), ("u", 2), ("v", 1)]
