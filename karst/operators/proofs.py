"""Checkpoints, witnesses and proof bundles (L9-L13) and the bytes that trust events sign."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions import ed25519
from karst.functions.bytesio import Reader, len32, sha256, u8, u16, u32, u64
from karst.operators import log, mmr

MMR_SHA256, ED25519, VERSION = 2, 1, 1  # fixed values of the record formats
BUNDLE_MAGIC, BUNDLE_VERSION, RANGE = b"WDBPBND1", 1, 2


def _named(prefix: str, what: str) -> bytes:
    return f"{prefix}.{what}.v1".encode() + b"\0"


@dataclass(frozen=True)
class Checkpoint:
    """A signed commitment to the events from_seq to to_seq of a log; ``root`` is that of all events up to to_seq."""

    log_id: str
    from_seq: int
    to_seq: int
    root: bytes
    creator: bytes
    created_ms: int
    ingested_ms: int
    previous: bytes | None = None
    extension: bytes = b""
    signature: bytes = bytes(64)
    kind: int = MMR_SHA256
    scheme: int = ED25519
    version: int = VERSION

    def payload(self, domain: str) -> bytes:
        prev = u8(0) if self.previous is None else u8(1) + self.previous
        return (
            _named(domain, "checkpoint.sign") + u8(self.version) + len32(self.log_id.encode()) + u64(self.from_seq) + u64(self.to_seq) + u8(self.kind) + self.root + prev
            + len32(self.creator) + u8(self.scheme) + u64(self.created_ms) + u64(self.ingested_ms) + len32(self.extension)
        )

    def record_hash(self, domain: str) -> bytes:
        return sha256(_named(domain, "checkpoint.record"), len32(self.payload(domain)), self.signature)

    def signed(self, seed: bytes, domain: str) -> Checkpoint:
        return replace(self, signature=ed25519.sign(seed, self.payload(domain)))

    def valid(self, domain: str) -> bool:
        return 0 < self.from_seq <= self.to_seq and ed25519.verify(self.creator, self.payload(domain), self.signature)


@dataclass(frozen=True)
class Witness:
    """A countersignature of a checkpoint."""

    log_id: str
    from_seq: int
    to_seq: int
    root: bytes
    checkpoint_hash: bytes
    identity: bytes
    observed_ms: int
    extension: bytes = b""
    signature: bytes = bytes(64)
    kind: int = MMR_SHA256
    scheme: int = ED25519
    version: int = VERSION

    def payload(self, domain: str) -> bytes:
        return (
            _named(domain, "witness.sign") + u8(self.version) + len32(self.log_id.encode()) + u64(self.from_seq) + u64(self.to_seq) + u8(self.kind) + self.root
            + self.checkpoint_hash + len32(self.identity) + u8(self.scheme) + u64(self.observed_ms) + len32(self.extension)
        )

    def record_hash(self, domain: str) -> bytes:
        return sha256(_named(domain, "witness.record"), len32(self.payload(domain)), self.signature)

    def matches(self, c: Checkpoint, domain: str) -> bool:
        return (self.log_id, self.from_seq, self.to_seq, self.kind, self.root, self.checkpoint_hash) == (c.log_id, c.from_seq, c.to_seq, c.kind, c.root, c.record_hash(domain))

    def valid(self, c: Checkpoint, domain: str) -> bool:
        return self.matches(c, domain) and ed25519.verify(self.identity, self.payload(domain), self.signature)


def witness(c: Checkpoint, seed: bytes, observed_ms: int, domain: str = "karst") -> Witness:
    w = Witness(c.log_id, c.from_seq, c.to_seq, c.root, c.record_hash(domain), ed25519.public_key(seed), observed_ms)
    return replace(w, signature=ed25519.sign(seed, w.payload(domain)))


class LogProblem(ValueError):
    pass


def record_hashes(events: DataFrame) -> DataFrame:
    """(log_id, leaf_index, leaf): the leaf of an event is the hash of its whole envelope."""
    return log.envelope(events).select("log_id", (F.col("seq") - 1).alias("leaf_index"), F.unhex(F.sha2("envelope", 256)).alias("leaf"))


def checkpoint(events: DataFrame, log_id: str, from_seq: int, to_seq: int, seed: bytes, created_ms: int, ingested_ms: int, previous: bytes | None = None, domain: str = "karst") -> Checkpoint:
    """A signed checkpoint of a log that has been verified; the root is computed in parallel, the driver signs 32 bytes."""
    d = events.filter((F.col("log_id") == log_id) & (F.col("seq") <= to_seq))
    bad = log.verify_chain(d).first()
    if bad is not None:
        raise LogProblem(f"{bad.problem} at {bad.seq}")
    row = mmr.roots(mmr.nodes(record_hashes(d), mmr.Domain(domain)), mmr.Domain(domain)).first()
    if row is None or row.leaf_count != to_seq or not 0 < from_seq <= to_seq:
        raise LogProblem("the log doesn't hold the range")
    c = Checkpoint(log_id, from_seq, to_seq, bytes(row.root), ed25519.public_key(seed), created_ms, ingested_ms, previous)
    return c.signed(seed, domain)


def bundle_parts(events: DataFrame, c: Checkpoint, domain: str = "karst") -> tuple[DataFrame, DataFrame]:
    """Records (seq, envelope, record_hash) and proofs (seq, leaf_hash, proof) of a checkpoint's range."""
    d = events.filter((F.col("log_id") == c.log_id) & (F.col("seq") <= c.to_seq))
    leaves = record_hashes(d)
    inside = F.col("seq") >= c.from_seq
    records = log.envelope(d.filter(inside)).select("seq", "envelope", F.unhex(F.sha2("envelope", 256)).alias("record_hash"))
    tree = mmr.nodes(leaves, mmr.Domain(domain))
    proofs = mmr.proofs(tree, leaves.filter(F.col("leaf_index") >= c.from_seq - 1)).join(leaves, ["log_id", "leaf_index"]).select((F.col("leaf_index") + 1).alias("seq"), F.col("leaf").alias("leaf_hash"), "proof")
    return records, proofs


def verify_parts(records: DataFrame, proofs: DataFrame, c: Checkpoint, domain: str = "karst") -> DataFrame:
    """(seq, problem) of records and proofs against a checkpoint, without the log.

    A checkpoint whose signature is wrong is a problem at 0. Missing records and proofs come from anti joins, hashes
    are checked in the JVM, envelopes and paths in Arrow batches.
    """
    spark = records.sparkSession
    none = spark.createDataFrame([] if c.valid(domain) else [(0, "signature")], "seq long, problem string")
    wanted = spark.range(c.from_seq, c.to_seq + 1).select(F.col("id").alias("seq"))
    missing = wanted.join(records, "seq", "left_anti").select("seq", F.lit("missing record").alias("problem"))
    unproved = wanted.join(proofs, "seq", "left_anti").select("seq", F.lit("missing proof").alias("problem"))
    outside = records.filter(~F.col("seq").between(c.from_seq, c.to_seq)).select("seq", F.lit("outside").alias("problem"))

    @F.pandas_udf("boolean")
    def envelope_ok(seq, data):
        def ok(s, b):
            try:
                e = log.decode(bytes(b))
            except (ValueError, UnicodeDecodeError):
                return False
            return e.seq == s and e.log_id == c.log_id

        return pd.Series([ok(s, b) for s, b in zip(seq, data)])

    wrong = records.filter((F.col("record_hash") != F.unhex(F.sha2("envelope", 256))) | ~envelope_ok("seq", "envelope")).select("seq", F.lit("record").alias("problem"))
    both = proofs.join(records.select("seq", "record_hash"), "seq")
    other = both.filter(F.col("leaf_hash") != F.col("record_hash")).select("seq", F.lit("leaf").alias("problem"))

    @F.pandas_udf("boolean")
    def proof_ok(seq, leaf, proof):
        def ok(s, x, b):
            try:
                p = mmr.Proof.decode(bytes(b))
            except ValueError:
                return False
            return p.leaf_index == s - 1 and p.leaf_count == c.to_seq and mmr.proof_valid(p, bytes(x), c.root, mmr.Domain(domain))

        return pd.Series([ok(s, x, b) for s, x, b in zip(seq, leaf, proof)])

    unproven = both.filter(~proof_ok("seq", "leaf_hash", "proof")).select("seq", F.lit("proof").alias("problem"))
    out = none
    for d in (missing, unproved, outside, wrong, other, unproven):
        out = out.unionByName(d)
    return out


@dataclass
class Bundle:
    """The byte form of a bundle: for one consumer's range, which it holds in memory."""

    log_id: str
    records: list[tuple[int, bytes, bytes]] = field(default_factory=list)  # seq, record hash, envelope
    proofs: list[tuple[int, bytes, bytes, bytes]] = field(default_factory=list)  # seq, leaf hash, checkpoint hash, proof
    checkpoints: list[Checkpoint] = field(default_factory=list)
    kind: int = RANGE
    extension: bytes = b""

    def encode(self) -> bytes:
        out = BUNDLE_MAGIC + u16(BUNDLE_VERSION) + u8(VERSION) + u8(self.kind) + len32(self.log_id.encode()) + len32(self.extension) + u32(len(self.records))
        out += b"".join(u64(s) + h + len32(e) + u8(0) + len32(b"") for s, h, e in self.records) + u32(len(self.proofs))
        out += b"".join(u64(s) + x + c + len32(p) + len32(b"") for s, x, c, p in self.proofs) + u32(len(self.checkpoints))
        for c in self.checkpoints:
            prev = u8(0) if c.previous is None else u8(1) + c.previous
            out += u8(c.version) + len32(c.log_id.encode()) + u64(c.from_seq) + u64(c.to_seq) + u8(c.kind) + c.root + prev + len32(c.creator) + u8(c.scheme) + u64(c.created_ms) + u64(c.ingested_ms) + len32(c.extension) + c.signature
        return out

    @staticmethod
    def decode(data: bytes) -> Bundle:
        r = Reader(data)
        r.expect(BUNDLE_MAGIC)
        if r.uint(2) != BUNDLE_VERSION or r.uint(1) != VERSION:
            raise ValueError("unknown version")
        kind, log_id, ext = r.uint(1), r.len32().decode(), r.len32()
        b = Bundle(log_id, kind=kind, extension=ext)
        for _ in range(r.uint(4)):
            seq, h, e = r.uint(8), r.take(32), r.len32()
            if r.uint(1):
                r.take(32)
                r.len32()
            r.len32()
            b.records.append((seq, h, e))
        for _ in range(r.uint(4)):
            b.proofs.append((r.uint(8), r.take(32), r.take(32), r.len32()))
            r.len32()
        for _ in range(r.uint(4)):
            version, name, first, last, acc, root = r.uint(1), r.len32().decode(), r.uint(8), r.uint(8), r.uint(1), r.take(32)
            prev = r.take(32) if r.uint(1) else None
            creator, scheme, created, ingested, extension = r.len32(), r.uint(1), r.uint(8), r.uint(8), r.len32()
            b.checkpoints.append(Checkpoint(name, first, last, root, creator, created, ingested, prev, extension, r.take(64), acc, scheme, version))
        r.end()
        return b


# -- trust events -------------------------------------------------------------------------------------------------------


def grant_bytes(from_org: bytes, to_org: bytes, cap_bits: int, prefixes: list[str], expires_ms: int, granted_ms: int, domain: str = "karst") -> bytes:
    return _named(domain, "trust.grant") + from_org + to_org + u8(cap_bits) + u32(len(prefixes)) + b"".join(len32(p.encode()) for p in prefixes) + u64(expires_ms) + u64(granted_ms)


def revoke_bytes(from_org: bytes, to_org: bytes, grant_seq: int, revoked_ms: int, domain: str = "karst") -> bytes:
    return _named(domain, "trust.revoke") + from_org + to_org + u64(grant_seq) + u64(revoked_ms)


def with_signature_check(trust: DataFrame, domain: str = "karst", name: str = "sig_ok") -> DataFrame:
    """Adds whether an event of a trust log (from_org and to_org in hex) is signed by from_org."""
    @F.pandas_udf("boolean")
    def ok(kind: pd.Series, a: pd.Series, b: pd.Series, caps: pd.Series, prefixes: pd.Series, exp: pd.Series, granted: pd.Series, seq: pd.Series, revoked: pd.Series, sig: pd.Series) -> pd.Series:
        def one(kind, a, b, caps, prefixes, exp, granted, seq, revoked, sig):
            try:
                x, y = bytes.fromhex(a), bytes.fromhex(b)
                zero = lambda v: 0 if v is None or v != v else int(v)
                m = grant_bytes(x, y, zero(caps), list(prefixes if prefixes is not None else []), zero(exp), zero(granted), domain) if kind == "grant" else revoke_bytes(x, y, zero(seq), zero(revoked), domain)
                return ed25519.verify(x, m, bytes(sig))
            except (ValueError, TypeError):
                return False

        return pd.Series([one(*r) for r in zip(kind, a, b, caps, prefixes, exp, granted, seq, revoked, sig)])

    return trust.withColumn(name, ok("kind", "from_org", "to_org", "cap_bits", "prefixes", "expires_at_ms", "granted_at_ms", "grant_seq", "revoked_at_ms", "sig"))
