"""Golden values (FIXTURES.md), chains, Merkle proofs and bundles."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from karst.functions import ed25519
from karst.functions.bytesio import sha256
from karst.operators import log, mmr, proofs

FIXTURES = (ROOT / "FIXTURES.md").read_text()
DOMAIN = re.search(r"MMR domain strings: `(\w+)\.proof", FIXTURES)[1]  # the prefix of logs made elsewhere
GOLDEN = dict(re.findall(r"\| ([^|]*?)(?: \[checked\])? \|[^|]*\| `([0-9a-f]{64})`", FIXTURES))
SEED = bytes.fromhex("8052030376d47112be7f73ed7a019293dd12ad910b654455798b4667d73de166")  # fixed value: a public test key
PAYLOADS = [("alpha payload", 1800000001000), ("bravo payload", 1800000002000), ("charlie payload", 1800000003000)]


def golden_chain(spark):
    d = spark.createDataFrame([("proof-spine:golden", i, ms, p) for i, (p, ms) in enumerate(PAYLOADS)], "log_id string, ord long, ingest_ms long, payload string")
    return log.build_chain(d)


def test_envelope():
    e = log.Envelope("field-log", 7, bytes(32), 1700000000123, b"payload-v1", (sha256(b"photo:sha256"),))
    assert e.event_hash().hex() == GOLDEN["envelope event hash"]
    assert log.decode(e.encode()) == e
    for i in (0, 12, 60, len(e.encode()) - 1):
        bad = bytearray(e.encode())
        bad[i] ^= 1
        with pytest.raises((ValueError, UnicodeDecodeError)):
            log.decode(bytes(bad))


def test_golden_chain_root_and_checkpoint(spark):
    chain = golden_chain(spark)
    assert [bytes(r.event_hash).hex() for r in chain.orderBy("seq").collect()] == [GOLDEN[f"chain event {i}"] for i in (1, 2, 3)]
    assert log.verify_chain(chain).count() == 0
    tree = mmr.nodes(proofs.record_hashes(chain), mmr.Domain(DOMAIN))
    assert bytes(mmr.roots(tree, mmr.Domain(DOMAIN)).first().root).hex() == GOLDEN["MMR root of the three record hashes"]
    c = proofs.checkpoint(chain, "proof-spine:golden", 1, 3, SEED, 1_800_000_000_000, 1_800_000_000_123, domain=DOMAIN)
    assert c.creator.hex() == "2d6f7455d97b4a3a10d7293909d1a4f2058cb9a370e43fa8154bb280db839083"
    assert c.record_hash(DOMAIN).hex() == GOLDEN["signed checkpoint hash"]


def test_trust_bytes():
    assert len(proofs.grant_bytes(b"\xaa" * 32, b"\xbb" * 32, 3, ["mem:acme:", "vec:"], 1700000000000, 1600000000000, DOMAIN)) == 128
    assert len(proofs.revoke_bytes(b"\xaa" * 32, b"\xbb" * 32, 7, 1700000000001, DOMAIN)) == 103


def test_jvm_hash_equals_python(spark):
    e = log.Envelope("l", 3, sha256(b"p"), 5, b"", (sha256(b"a"), sha256(b"b")))
    d = spark.createDataFrame([("l", 3, bytearray(e.prev_hash), 5, [bytearray(a) for a in e.attachments], bytearray())], "log_id string, seq long, prev_hash binary, ingest_ms long, attachments array<binary>, payload binary")
    assert bytes(log.with_event_hash(d).first().event_hash) == e.event_hash()


def test_chain_problems(spark):
    chain = golden_chain(spark)
    bad = lambda d: {(r.seq, r.problem) for r in log.verify_chain(d).collect()}
    assert bad(chain.withColumn("payload", F.when(F.col("seq") == 2, F.lit(bytearray(b"x"))).otherwise(F.col("payload")))) == {(2, "payload_hash")}
    assert bad(chain.filter("seq <> 2")) == {(3, "sequence")}
    assert bad(chain.withColumn("ingest_ms", F.col("ingest_ms") + (F.col("seq") == 3).cast("int"))) == {(3, "event_hash")}
    swapped = log.with_event_hash(chain.withColumn("prev_hash", F.when(F.col("seq") == 3, F.lit(bytearray(32))).otherwise(F.col("prev_hash"))).drop("event_hash"))
    assert bad(swapped) == {(3, "prev_hash")}
    assert bad(chain.limit(0)) == set()


def test_appending_goes_on_from_the_head(spark):
    rows = spark.createDataFrame([("a", i, i, f"p{i}") for i in range(7)], "log_id string, ord long, ingest_ms long, payload string")
    whole = log.build_chain(rows)
    first = log.build_chain(rows.filter("ord < 3"))
    heads = log.log_report(first).select("log_id", F.col("last_seq").alias("seq"), F.col("head_hash").alias("event_hash"))
    rest = log.build_chain(rows.filter("ord >= 3"), heads)
    assert sorted(bytes(r.event_hash) for r in first.unionByName(rest).collect()) == sorted(bytes(r.event_hash) for r in whole.collect())


@pytest.mark.parametrize("n", [1, 2, 7, 9, 16, 37])
def test_every_leaf_is_proved(spark, n):
    leaves = spark.createDataFrame([("l", i, bytearray(f"leaf{i}".encode())) for i in range(n)], "log_id string, leaf_index long, leaf binary")
    tree = mmr.nodes(leaves, bits=2)
    assert [p.height for p in mmr.peaks(tree).first().peaks] == mmr.peak_heights(n)
    root = bytes(mmr.roots(tree).first().root)
    rows = {r.leaf_index: bytes(r.proof) for r in mmr.proofs(tree, leaves).collect()}
    assert len(rows) == n
    for i, b in rows.items():
        p = mmr.Proof.decode(b)
        assert p.encode() == b and mmr.proof_valid(b, f"leaf{i}".encode(), root)
        assert not mmr.proof_valid(b, b"other", root) and not mmr.proof_valid(b[:-1], f"leaf{i}".encode(), root)
        bad = bytearray(b)
        bad[-1] ^= 1
        assert not mmr.proof_valid(bytes(bad), f"leaf{i}".encode(), root)
    assert mmr.proofs(tree, spark.createDataFrame([("l", n), ("l", -1)], "log_id string, leaf_index long")).count() == 0


def test_bundle(spark):
    rows = spark.createDataFrame([("b", i, i, f"p{i}") for i in range(6)], "log_id string, ord long, ingest_ms long, payload string")
    chain = log.build_chain(rows)
    c = proofs.checkpoint(chain, "b", 3, 6, SEED, 1, 2)
    records, paths = proofs.bundle_parts(chain, c)
    assert records.count() == paths.count() == 4
    problems = lambda r, p, x=c: {(y.seq, y.problem) for y in proofs.verify_parts(r, p, x).collect()}
    assert problems(records, paths) == set()
    assert problems(records.filter("seq <> 4"), paths) >= {(4, "missing record")}
    assert problems(records, paths.filter("seq <> 4")) == {(4, "missing proof")}
    assert (0, "signature") in problems(records, paths, proofs.Checkpoint("b", 3, 6, c.root, c.creator, 9, 2, signature=c.signature))
    assert (5, "record") in problems(records.withColumn("envelope", F.when(F.col("seq") == 5, F.lit(bytearray(b"zz"))).otherwise(F.col("envelope"))), paths)
    w = proofs.witness(c, bytes(range(32)), 5)
    assert w.valid(c, "karst") and not w.valid(c.signed(bytes(32), "karst"), "karst")
    b = proofs.Bundle("b", [(r.seq, bytes(r.record_hash), bytes(r.envelope)) for r in records.collect()], [(r.seq, bytes(r.leaf_hash), c.record_hash("karst"), bytes(r.proof)) for r in paths.collect()], [c])
    assert proofs.Bundle.decode(b.encode()) == b
    with pytest.raises(ValueError):
        proofs.Bundle.decode(b.encode()[:-1])


def test_prefix_root(spark):
    def root(rows):
        name = lambda x: f"karst.prefix-root.{x}.v1".encode()
        n8 = lambda b: len(b).to_bytes(8, "big") + b
        level = [sha256(name("leaf"), n8(k.encode()), n8(v.encode()), bytes([w]), t.to_bytes(8, "big")) for k, v, t, w in sorted(rows)]
        while len(level) > 1:
            level = [sha256(name("node"), *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else sha256(name("empty"), n8(b"p:"))

    for n in (0, 1, 2, 5, 8, 21):
        rows = [(f"p:{i * 7 % 100:02}", f"v{i}", i, i % 2 == 0) for i in range(n)]
        d = spark.createDataFrame([*rows, ("q", "z", 1, False)], "key string, value string, ts_ms long, is_worm boolean")
        got = mmr.prefix_root(d, "p:", bits=2).first()
        assert got.entries == n and bytes(got.root) == root(rows)


def test_ed25519():
    pub = ed25519.public_key(bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60"))
    assert pub.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    s = ed25519.sign(bytes(32), b"m")
    assert ed25519.verify(ed25519.public_key(bytes(32)), b"m", s)
    assert not ed25519.verify(ed25519.public_key(bytes(32)), b"n", s) and not ed25519.verify(b"", b"m", s) and not ed25519.verify(pub, b"m", bytes(64))
