"""Append-only logs (L1-L4): envelopes, hash chains and their verification.

Building a chain depends on the hash before, so it streams through one task per log. Verifying one doesn't: each row's
hashes are checked by itself and its link against the row before, in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.bytesio import ZERO_HASH, Reader, col_bytes, col_len32, col_sha256, col_uint, len32, sha256, u16, u32, u64
from karst.functions.folds import ordered_fold
from karst.functions.ranks import previous

MAGIC, VERSION = b"WDBALOG1", 1  # fixed values of the envelope format
EVENT = "log_id string, seq long, prev_hash binary, ingest_ms long, payload_hash binary, attachments array<binary>, payload binary, event_hash binary"


@dataclass(frozen=True)
class Envelope:
    log_id: str
    seq: int
    prev_hash: bytes
    ingest_ms: int
    payload: bytes
    attachments: tuple[bytes, ...] = ()

    def preimage(self) -> bytes:
        return MAGIC + u16(VERSION) + len32(self.log_id.encode()) + u64(self.seq) + self.prev_hash + u64(self.ingest_ms) + sha256(self.payload) + u32(len(self.attachments)) + b"".join(self.attachments) + len32(self.payload)

    def event_hash(self) -> bytes:
        return sha256(self.preimage())

    def encode(self) -> bytes:
        p = self.preimage()
        return p + sha256(p)


def decode(data: bytes) -> Envelope:
    """The envelope of canonical bytes; a ValueError where they are none or a hash is wrong."""
    r = Reader(data)
    r.expect(MAGIC)
    if r.uint(2) != VERSION:
        raise ValueError("unknown version")
    log_id, seq, prev, ms, payload_hash = r.len32().decode(), r.uint(8), r.take(32), r.uint(8), r.take(32)
    attachments = tuple(r.take(32) for _ in range(r.uint(4)))
    e = Envelope(log_id, seq, prev, ms, r.len32(), attachments)
    if sha256(e.payload) != payload_hash or r.take(32) != e.event_hash():
        raise ValueError("a hash doesn't match")
    r.end()
    return e


def preimage(log_id: Column, seq: Column, prev_hash: Column, ingest_ms: Column, attachments: Column, payload: Column) -> Column:
    """The hashed bytes of an envelope, in the JVM. ``attachments``: array of hashes, null for none."""
    n = F.greatest(F.coalesce(F.size(attachments), F.lit(0)), F.lit(0))
    joined = F.unhex(F.array_join(F.transform(F.coalesce(attachments, F.array().cast("array<binary>")), lambda x: F.hex(x)), ""))
    return F.concat(col_bytes(MAGIC + u16(VERSION)), col_len32(log_id.cast("binary")), col_uint(seq, 8), prev_hash, col_uint(ingest_ms, 8), col_sha256(payload), col_uint(n, 4), joined, col_len32(payload))


def with_event_hash(events: DataFrame, name: str = "event_hash") -> DataFrame:
    """Adds the hash of each event's envelope."""
    return events.withColumn(name, col_sha256(preimage(*[F.col(c) for c in ("log_id", "seq", "prev_hash", "ingest_ms", "attachments", "payload")])))


def envelope(events: DataFrame, name: str = "envelope") -> DataFrame:
    """Adds the whole envelope."""
    pre = preimage(*[F.col(c) for c in ("log_id", "seq", "prev_hash", "ingest_ms", "attachments", "payload")])
    return events.withColumn(name, F.concat(pre, F.col("event_hash")))


def build_chain(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``EVENT`` rows of (log_id, ord, ingest_ms, payload[, attachments]) appended in the order of ``ord``.

    ``heads`` (log_id, seq, event_hash) continues logs that exist. Ties of ``ord`` go by payload.
    """
    d = rows if "attachments" in rows.columns else rows.withColumn("attachments", F.array().cast("array<binary>"))
    d = d.select("log_id", "ord", "ingest_ms", F.coalesce(F.col("payload").cast("binary"), F.lit(bytearray())).alias("payload"), "attachments").filter("log_id is not null")
    if heads is None:
        d = d.withColumns({"seq": F.lit(0).cast("long"), "event_hash": F.lit(None).cast("binary")})
    else:
        d = d.join(heads.select("log_id", "seq", "event_hash"), "log_id", "left").withColumn("seq", F.coalesce("seq", F.lit(0)))

    def step(state, row):
        seq, prev = state or (row["seq"], row["event_hash"] or ZERO_HASH)
        e = Envelope(row["log_id"], seq + 1, prev, row["ingest_ms"] or 0, row["payload"], tuple(row["attachments"] or ()))
        h = e.event_hash()
        return (e.seq, h), [(e.log_id, e.seq, prev, e.ingest_ms, sha256(e.payload), list(e.attachments), e.payload, h)]

    return ordered_fold(d, ["log_id"], ["ord", "payload"], EVENT, lambda _k: None, step)


PROBLEMS = ["payload_hash", "event_hash", "sequence", "prev_hash"]


def verify_chain(events: DataFrame) -> DataFrame:
    """(log_id, seq, problem) of each event that breaks its log; no rows where all is well.

    ``sequence``: the numbers aren't 1, 2, 3 ...; ``prev_hash``: the link to the event before is wrong. Rows are compared
    with the one before by stretches of a log, so a log that holds most rows is spread over tasks.
    """
    d = previous(with_event_hash(events, "expected"), ["log_id"], F.floor(F.col("seq") / 65_536), ["seq", "event_hash"], ["event_hash", "seq"], "before")
    problem = (
        F.when(~F.col("payload_hash").eqNullSafe(col_sha256(F.col("payload"))), "payload_hash")
        .when(~F.col("event_hash").eqNullSafe(F.col("expected")), "event_hash")
        .when(F.col("seq") != F.coalesce(F.col("before.seq"), F.lit(0)) + 1, "sequence")
        .when(~F.col("prev_hash").eqNullSafe(F.coalesce(F.col("before.event_hash"), F.lit(bytearray(ZERO_HASH)))), "prev_hash")
    )
    return d.withColumn("problem", problem).filter("problem is not null").select("log_id", "seq", "problem")


def log_report(events: DataFrame) -> DataFrame:
    """(log_id, events, last_seq, head_hash)."""
    return events.groupBy("log_id").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"), F.max_by("event_hash", "seq").alias("head_hash"))
