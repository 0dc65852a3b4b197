"""Merkle mountain ranges (L5-L8) and roots over sorted rows.

Leaves are cut into blocks of 2^BLOCK_BITS; each block is one task and gives the root of its full subtree (or the peaks of
the last, partial one), and the same is done with these roots, so a log of n leaves takes log n / BLOCK_BITS rounds and no task
holds more than a block. Domain strings start with a prefix that the caller may set, to match roots made elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions.bytesio import Reader, col_bytes, col_len64, col_sha256, col_uint, sha256, u8, u16, u32, u64
from karst.functions.ranks import global_rank
from karst.runtime import written

BLOCK_BITS = 12
PROOF_MAGIC, PROOF_VERSION, LEFT, RIGHT = b"WDBMMR1", 1, 0, 1  # fixed values of the proof format


@dataclass(frozen=True)
class Domain:
    """The hash functions under a domain prefix."""

    prefix: str = "karst"

    def _name(self, what: str) -> bytes:
        return f"{self.prefix}.proof.mmr.{what}.v1".encode() + b"\0"

    def leaf(self, index: int, data: bytes) -> bytes:
        return sha256(self._name("leaf"), u64(index), u64(len(data)), data)

    def parent(self, height: int, left: bytes, right: bytes) -> bytes:
        return sha256(self._name("parent"), u8(height), left, right)

    def root(self, leaves: int, peaks: list[tuple[int, bytes]]) -> bytes:
        return sha256(self._name("root"), u64(leaves), u64(len(peaks)), *[u8(h) + x for h, x in peaks])


def peak_heights(leaves: int) -> list[int]:
    return [h for h in range(63, -1, -1) if leaves >> h & 1]


@dataclass(frozen=True)
class Proof:
    leaf_index: int
    leaf_count: int
    peak_index: int
    path: tuple[tuple[int, bytes], ...]  # (side of the sibling, its hash), from the leaf up
    peaks: tuple[tuple[int, bytes], ...]  # (height, hash)

    def encode(self) -> bytes:
        return (
            PROOF_MAGIC + u16(PROOF_VERSION) + u64(self.leaf_index) + u64(self.leaf_count) + u32(self.peak_index)
            + u32(len(self.path)) + b"".join(u8(s) + h for s, h in self.path) + u32(len(self.peaks)) + b"".join(u8(n) + h for n, h in self.peaks)
        )

    @staticmethod
    def decode(data: bytes) -> Proof:
        r = Reader(data)
        r.expect(PROOF_MAGIC)
        if r.uint(2) != PROOF_VERSION:
            raise ValueError("unknown version")
        index, count, peak = r.uint(8), r.uint(8), r.uint(4)
        n = r.uint(4)
        if n > 64:
            raise ValueError("path too long")
        path = tuple((r.uint(1), r.take(32)) for _ in range(n))
        n = r.uint(4)
        if n > 64:
            raise ValueError("too many peaks")
        peaks = tuple((r.uint(1), r.take(32)) for _ in range(n))
        r.end()
        if any(s not in (LEFT, RIGHT) for s, _ in path):
            raise ValueError("unknown side")
        return Proof(index, count, peak, path, peaks)


def proof_valid(proof: Proof | bytes, leaf: bytes, root: bytes, domain: Domain = Domain()) -> bool:
    """Whether the proof shows that ``leaf`` is in the tree of ``root``; bytes that are no proof show nothing."""
    try:
        p = Proof.decode(proof) if isinstance(proof, bytes) else proof
    except ValueError:
        return False
    heights = peak_heights(p.leaf_count)
    if not 0 <= p.leaf_index < p.leaf_count or p.peak_index >= len(p.peaks) or [h for h, _ in p.peaks] != heights:
        return False
    start = sum(1 << h for h in heights[: p.peak_index])
    height = heights[p.peak_index]
    if not start <= p.leaf_index < start + (1 << height) or len(p.path) != height:
        return False
    h, pos = domain.leaf(p.leaf_index, leaf), p.leaf_index - start
    for level, (side, other) in enumerate(p.path):
        if side != (LEFT if pos & 1 else RIGHT):
            return False
        h = domain.parent(level + 1, other, h) if pos & 1 else domain.parent(level + 1, h, other)
        pos >>= 1
    return h == p.peaks[p.peak_index][1] and domain.root(p.leaf_count, list(p.peaks)) == root


NODES = "log_id string, height int, pos long, hash binary"


def nodes(leaves: DataFrame, domain: Domain = Domain(), bits: int = BLOCK_BITS) -> DataFrame:
    """All nodes (log_id, height, pos, hash) of the full subtrees over (log_id, leaf_index, leaf), leaf_index from 0 without gaps.

    Peaks are among them: of n leaves, node (h, (n >> h) - 1) for each bit h of n.
    """

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        log, base, pos = t["log_id"][0].as_py(), t["height"][0].as_py(), t["pos"].to_pylist()
        level, out = dict(zip(pos, t["hash"].to_pylist())), []
        for h in range(base + 1, base + bits + 1):
            level = {p >> 1: domain.parent(h, level[p], level[p + 1]) for p in level if not p & 1 and p + 1 in level}
            out += [(log, h, p, x) for p, x in level.items()]
        return pa.table({"log_id": pa.array([r[0] for r in out], pa.string()), "height": pa.array([r[1] for r in out], pa.int32()), "pos": pa.array([r[2] for r in out], pa.int64()), "hash": pa.array([r[3] for r in out], pa.binary())})

    name = col_bytes(domain._name("leaf"))
    data = F.col("leaf").cast("binary")
    level = leaves.filter("log_id is not null").select("log_id", F.lit(0).alias("height"), F.col("leaf_index").cast("long").alias("pos"), col_sha256(F.concat(name, col_uint(F.col("leaf_index"), 8), col_len64(data))).alias("hash"))
    done = level = written(level, "leaves")
    base = 0
    while not level.filter("pos > 0").isEmpty():
        made = written(level.groupBy("log_id", "height", F.shiftright("pos", bits).alias("block")).applyInArrow(build, NODES), "nodes")
        done = done.unionByName(made)
        base += bits
        level = made.filter(F.col("height") == base)
    return done


def peaks(tree: DataFrame) -> DataFrame:
    """(log_id, leaf_count, peaks) of each tree, peaks from the left, as (height, hash)."""
    count = tree.filter("height = 0").groupBy("log_id").agg(F.count(F.lit(1)).alias("leaf_count"))
    is_peak = (F.expr("shiftright(leaf_count, height) & 1") == 1) & (F.col("pos") == F.expr("shiftright(leaf_count, height)") - 1)
    d = tree.join(count, "log_id").filter(is_peak)  # at most 63 rows of a log
    return d.groupBy("log_id", "leaf_count").agg(F.reverse(F.sort_array(F.collect_list(F.struct("height", "hash")))).alias("peaks"))


def roots(tree: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """(log_id, leaf_count, root), in the JVM."""
    body = F.unhex(F.array_join(F.transform("peaks", lambda p: F.concat(F.lpad(F.hex(p["height"]), 2, "0"), F.hex(p["hash"]))), ""))
    return peaks(tree).select("log_id", "leaf_count", col_sha256(F.concat(col_bytes(domain._name("root")), col_uint(F.col("leaf_count"), 8), col_uint(F.size("peaks"), 8), body)).alias("root"))


def proofs(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(log_id, leaf_index, proof) with the proof's bytes for each of ``wanted`` (log_id, leaf_index); indexes beyond the log give no row."""
    p = peaks(tree)
    w = wanted.select("log_id", F.col("leaf_index").cast("long").alias("leaf_index")).distinct().join(p, "log_id").filter("leaf_index >= 0 and leaf_index < leaf_count")
    # The peak above a leaf is that of the highest bit in which count and index differ.
    state = lambda start, height, nth, seen: f"named_struct('start', {start}, 'height', {height}, 'nth', {nth}, 'seen', {seen})"
    here = "shiftleft(1L, h)"
    found, passed, same = state("s.start", "h", "s.seen", "s.seen + 1"), state(f"s.start + {here}", "s.height", "s.nth", "s.seen + 1"), state("s.start", "s.height", "s.nth", "s.seen")
    start = F.expr(f"aggregate(sequence(63, 0), {state('0L', '-1', '-1', '0')}, (s, h) -> if(s.height < 0 and (shiftright(leaf_count, h) & 1) = 1, if(leaf_index < s.start + {here}, {found}, {passed}), {same}))")
    w = w.withColumn("at", start).select("log_id", "leaf_index", "leaf_count", "peaks", F.col("at.height").alias("top"), F.col("at.nth").alias("peak_index"))
    steps = w.filter("top > 0").select("log_id", "leaf_index", F.explode(F.sequence(F.lit(0), F.col("top") - 1)).alias("height")).withColumn("own", F.expr("shiftright(leaf_index, height)"))
    sibling = steps.select("log_id", "leaf_index", "height", F.col("own").bitwiseXOR(F.lit(1).cast("long")).alias("pos"), F.when(F.col("own") % 2 == 1, LEFT).otherwise(RIGHT).alias("side"))
    path = sibling.join(tree, ["log_id", "height", "pos"]).groupBy("log_id", "leaf_index").agg(F.sort_array(F.collect_list(F.struct("height", "side", "hash"))).alias("path"))
    item = lambda n, h: F.concat(F.lpad(F.hex(n), 2, "0"), F.hex(h))
    d = w.join(path, ["log_id", "leaf_index"], "left")
    steps_ = F.coalesce("path", F.array().cast("array<struct<height:int,side:int,hash:binary>>"))
    data = F.concat(
        col_bytes(PROOF_MAGIC + u16(PROOF_VERSION)), col_uint(F.col("leaf_index"), 8), col_uint(F.col("leaf_count"), 8), col_uint(F.col("peak_index"), 4),
        col_uint(F.size(steps_), 4), F.unhex(F.array_join(F.transform(steps_, lambda s: item(s["side"], s["hash"])), "")),
        col_uint(F.size("peaks"), 4), F.unhex(F.array_join(F.transform("peaks", lambda s: item(s["height"], s["hash"])), "")),
    )
    return d.select("log_id", "leaf_index", data.alias("proof"))


def check_proofs(rows: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """Adds ``valid`` to rows of (proof, leaf, root)."""

    @F.pandas_udf("boolean")
    def valid(proof, leaf, root):
        import pandas as pd

        return pd.Series([p is not None and x is not None and r is not None and proof_valid(bytes(p), bytes(x), bytes(r), domain) for p, x, r in zip(proof, leaf, root)])

    return rows.withColumn("valid", valid("proof", "leaf", "root"))


# -- roots over sorted rows ---------------------------------------------------------------------------------------------


def prefix_root(kv: DataFrame, prefix: str = "", first: int = 0, domain: str = "karst", bits: int = BLOCK_BITS) -> DataFrame:
    """(entries, root) of the Merkle tree over the rows (key, value, is_worm, ts_ms) below ``prefix`` in order of key, or over the ``first`` of them.

    An odd node moves up as it is. No rows have the root of the empty tree. Rows are partitioned by ranges of the key, and positions come from
    ranks within a range and the counts of the ranges before, so no task sorts the whole table, whatever the keys have in common; then blocks are hashed as in ``nodes``.
    """
    name = lambda what: f"{domain}.prefix-root.{what}.v1".encode()
    d = kv.filter(F.col("key").startswith(prefix)).select("key", "value", "is_worm", "ts_ms")
    if first:
        d = d.orderBy("key").limit(first)
    k = F.col("key").cast("binary")
    v = F.coalesce(F.col("value").cast("binary"), F.lit(bytearray()))
    leaf = col_sha256(F.concat(col_bytes(name("leaf")), col_len64(k), col_len64(v), F.when(F.col("is_worm"), F.lit(bytearray(b"\x01"))).otherwise(F.lit(bytearray(b"\0"))), col_uint(F.col("ts_ms"), 8)))
    ranges = written(d.select("key", leaf.alias("hash"), F.lit(0).alias("one")).repartitionByRange("key").withColumn("range", F.spark_partition_id()), "ranges")
    level = global_rank(ranges, ["one"], F.col("range"), ["key", "hash"])
    level = written(level.select((F.col("rank") - 1).alias("pos"), "hash"), "leaves")
    n = entries = level.count()

    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        hashes, at = t["hash"].to_pylist(), t["pos"][0].as_py() >> bits
        while len(hashes) > 1:
            hashes = [sha256(name("node"), *hashes[i : i + 2]) if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
        return pa.table({"pos": [at], "hash": pa.array(hashes, pa.binary())})

    while n > 1:
        level = written(level.groupBy(F.shiftright("pos", bits).alias("block")).applyInArrow(up, "pos long, hash binary"), "nodes")
        n = (n + (1 << bits) - 1) >> bits
    if entries == 0:
        empty = sha256(name("empty"), u64(len(prefix.encode())), prefix.encode())
        return kv.sparkSession.createDataFrame([(0, bytearray(empty))], "entries long, root binary")
    return level.select(F.lit(entries).cast("long").alias("entries"), F.col("hash").alias("root"))


def sync_plan(mine: DataFrame, theirs: DataFrame, prefix: str = "", domain: str = "karst") -> DataFrame:
    """(action, mine, theirs): what brings the other side up to date, by roots alone.

    ``none`` where the roots are equal; ``tail`` where theirs is the root of my first rows, of which there are as many as they have; else ``full``.
    """
    a, b = prefix_root(mine, prefix, 0, domain).first(), prefix_root(theirs, prefix, 0, domain).first()  # one row each
    action = "none" if a.root == b.root else "full"
    if action == "full" and 0 < b.entries < a.entries:
        action = "tail" if prefix_root(mine, prefix, b.entries, domain).first().root == b.root else "full"
    elif action == "full" and b.entries == 0:
        action = "tail"
    return mine.sparkSession.createDataFrame([(action, a.entries, b.entries)], "action string, mine long, theirs long")


def table_difference(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, status) of rows (key, value, is_worm, ts_ms) to send (``only_mine``), to fetch (``only_theirs``) or that differ."""
    image = F.xxhash64("value", "is_worm", "ts_ms")
    full = F.sha2(F.concat_ws("\x1f", F.col("value").cast("string"), F.col("is_worm").cast("string"), F.col("ts_ms").cast("string")), 256)
    a = mine.select("key", full.alias("a"), image.alias("a2"))
    b = theirs.select("key", full.alias("b"), image.alias("b2"))
    d = a.join(b, "key", "full_outer")
    status = F.when(F.col("b").isNull(), "only_mine").when(F.col("a").isNull(), "only_theirs").when((F.col("a") != F.col("b")) | (F.col("a2") != F.col("b2")), "differs")
    return d.select("key", status.alias("status")).filter("status is not null")
