"""Publish and subscribe (R1-R7) and event-time windows by Structured Streaming.

A channel is a column of a folder of Parquet files: publishing appends, subscribing reads the folder as a stream, so
delivery to a file sink is exactly once and nothing is lost while no one listens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from karst.functions.predicate import predicate
from karst.operators.changes import record_kind
from karst.operators.folds import TASK_EVENT, TASK_STATE, Hold, TaskFold

MESSAGE = "channel string, message string, ts_ms long"


def publish(messages: DataFrame, folder: str) -> None:
    """Appends (channel, message, ts_ms)."""
    messages.select("channel", "message", "ts_ms").write.mode("append").parquet(folder)


def subscribe(spark: SparkSession, folder: str, channel: str | None = None, where: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """A stream of the messages of a channel (exact name) that meet a predicate over their JSON; its ``ts`` is the top-level field of that name."""
    d = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return filtered(d, channel, where)


def filtered(d: DataFrame, channel: str | None = None, where: str | None = None) -> DataFrame:
    """The same on any DataFrame of messages, batch or stream."""
    if channel is not None:
        d = d.filter(F.col("channel") == channel)
    if where is not None:
        d = d.filter(predicate(where, "message", F.get_json_object("message", "$.ts").try_cast("bigint")))
    return d


def derived(feed: DataFrame) -> DataFrame:
    """The messages that the changes of a feed (record_type, key, timestamp) give rise to: <ns>inserted and <ns>deleted for
    vectors, mem:<ns>:added for bodies of documents and chat:<room> for chat messages; batch or stream."""
    kind, key = record_kind(F.col("record_type")), F.col("key")
    ns = F.regexp_extract(key, r"(?s)^(.*:)", 1)
    is_body = key.startswith("mem:") & ~key.endswith(":meta")
    channel = (
        F.when(kind == "vinsert", F.concat(ns, F.lit("inserted")))
        .when(kind == "vdelete", F.concat(ns, F.lit("deleted")))
        .when((kind == "set") & is_body, F.concat(ns, F.lit("added")))
        .when((kind == "set") & key.startswith("chat:"), F.concat(F.lit("chat:"), F.split_part(key, F.lit(":"), F.lit(2))))
    )
    return feed.select(channel.alias("channel"), F.to_json(F.struct("key")).alias("message"), F.col("timestamp").alias("ts_ms")).filter("channel is not null")


def bulk_messages(batches: DataFrame) -> DataFrame:
    """The message of each bulk add (ns, count, ts_ms) on mem:<ns>:added.bulk."""
    channel = F.concat(F.lit("mem:"), "ns", F.lit(":added.bulk"))
    return batches.select(channel.alias("channel"), F.to_json(F.struct(F.col("ns").alias("namespace"), "count")).alias("message"), "ts_ms")


def presence_messages(changes: DataFrame) -> DataFrame:
    """The message of each change (node, ts_ms, change) of ``folds.transitions`` on cluster:presence, with the state it leads to."""
    state = F.when(F.col("change") == "recover", "alive").when(F.col("change") == "suspect", "suspected").otherwise(F.col("change"))
    return changes.select(F.lit("cluster:presence").alias("channel"), F.to_json(F.struct(F.col("change").alias("event"), "node", state.alias("state"))).alias("message"), "ts_ms")


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes what is there and ends; gives the sink's rows. Run again with the same checkpoint, it goes on from there."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def window_counts(d: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start_ms, end_ms, *keys, events) of tumbling or sliding windows; events later than ``late`` are dropped from streams."""
    w = F.window("__t", width, slide) if slide else F.window("__t", width)
    t = d.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    c = t.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return c.select(F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), *keys, "events")


def session_counts(d: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """(start_ms, end_ms, *keys, events) of sessions that end after a gap without events."""
    t = d.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    c = t.groupBy(F.session_window("__t", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return c.select(F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), *keys, "events")


def deduplicated(d: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each event of a key once, within the watermark."""
    t = d.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    return t.dropDuplicatesWithinWatermark(keys).drop("__t")


def task_states(events: DataFrame, now_ms: int) -> DataFrame:
    """The batch fold of tasks as a stream: a row with the new state after each micro-batch that has events of a task, with late ones passed over."""
    kinds = [f.split()[0] for f in TASK_EVENT.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, s = 0, TaskFold()
        if state.exists:
            last, epoch, base, requests, *v = state.get
            s = TaskFold(epoch, base, Hold(*v[:4]) if v[0] is not None else None, requests, tuple(v[4:]) if v[5] is not None else None)
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            if r["seq"] > last:
                s, last = s.step({**r, "seq": int(r["seq"])}), int(r["seq"])
        hold = (None,) * 4 if s.hold is None else (s.hold.seq, s.hold.winner, s.hold.granted_seq, s.hold.expires)
        state.update((last, s.epoch, s.base, s.requests, *hold, *(s.best or (None,) * 3)))
        yield pd.DataFrame([(*key, *s.state(now_ms))], columns=[c.split()[0] for c in TASK_STATE.split(", ")])

    columns = "last long, epoch long, base string, requests int, g_seq long, g_winner string, g_granted long, g_expires long, b_hlc long, b_seq long, b_by string"
    return events.select(*kinds).groupBy("log_id", "task").applyInPandasWithState(fold, TASK_STATE, columns, "update", GroupStateTimeout.NoTimeout)


def unsubscribe(query) -> None:
    """Ends a running subscription; what its sink has stays, and the same checkpoint goes on from there."""
    query.stop()
    query.awaitTermination()


def counters(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """(channels, publishes, subscribers) of a folder's messages and the session's running streams. Nothing is ever dropped."""
    return messages.agg(F.count_distinct("channel").alias("channels"), F.count(F.lit(1)).alias("publishes"), F.lit(len(spark.streams.active)).alias("subscribers"))


def progress(query) -> dict[str, int]:
    """Counters of a running query."""
    p = query.lastProgress
    return {"batches": 0 if p is None else p["batchId"] + 1, "rows": 0 if p is None else p["numInputRows"]}
