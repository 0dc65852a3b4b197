"""Search, quantization, key-value, memory, sources and registry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.functions import access
from karst.functions import vectors as V
from karst.operators import kv, memory, quantize, search
from karst.registry import REGISTRY, call, register
from karst.sources import feed_files, tables

VEC = "key string, vector array<float>, is_worm boolean, ts_ms long"


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([("vec:t:a", [1.0, 0.0, 0.0, 0.0], False, 1), ("vec:t:b", [0.9, 0.1, 0.0, 0.0], False, 2), ("vec:t:c", [0.0, 1.0, 0.0, 0.0], True, 3), ("vec:t:n", None, False, 3), ("vec:t:s", [1.0], False, 3), ("vec:u:z", [0.0, 0.0, 0.0, 0.0], False, 4)], VEC)


def keys(df):
    return [r.key for r in df.collect()]


def test_search(four):
    q = [1.0, 0.0, 0.0, 0.0]
    assert keys(search.search(four, q, 2, "vec:t:")) == ["vec:t:a", "vec:t:b"]
    assert keys(search.search_by_key(four, "vec:t:a", k=1)) == ["vec:t:b"]
    assert keys(search.search(four, q, 2, metric="no such")) == ["vec:t:a", "vec:t:b"]
    assert keys(search.search_by_key(four, "nobody")) == []
    assert search.search(four, q, 0).count() == 4
    assert [r.score for r in search.search(four, [1.0, 2.0, 3.0, 5.0], 10, metric="l2", mode="exact").filter("key = 'vec:t:c'").collect()] == [round(1 / 37, 6)]
    assert keys(search.search(four, q, 2, mode="bq_rerank")) == ["vec:t:a", "vec:t:b"]
    assert keys(search.search(four.limit(0), q)) == []
    with pytest.raises(ValueError):
        search.search(four, q, tau_hours=0)
    plan = search.search(four, q, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_ties_go_by_key(spark):
    d = spark.createDataFrame([(f"vec:{i}", [1.0, 0.0], False, 0) for i in (3, 1, 2)], VEC)
    assert keys(search.search(d, [1.0, 0.0], 2)) == ["vec:1", "vec:2"]


def test_pair(four):
    assert search.similarity_of_pair(four, "vec:t:a", "vec:t:c", "l2").first().score == round(2**0.5, 6)
    assert search.similarity_of_pair(four, "vec:t:a", "vec:u:z").first().score == 0
    with pytest.raises(Exception, match="dimensions differ"):
        search.similarity_of_pair(four, "vec:t:a", "vec:t:s").collect()


def test_decay(spark):
    h = 3_600_000
    d = spark.createDataFrame([(0.8, 0, 0, 0.0, 24.0, 0.8), (0.8, 48 * h, 0, 1.0, 24.0, 0.1353), (0.8, 24 * h, 0, 1.0, 24.0, 0.3679), (0.8, 0, 99 * h, 1.0, 24.0, 1.0)], "s double, now long, ts long, lam double, tau double, want double")
    for r in d.collect():
        got = spark.createDataFrame([(r.s, r.ts)], "s double, ts long").select(V.decayed(F.col("s"), F.col("ts"), r.lam, r.now, r.tau).alias("x")).first().x
        assert abs(got - r.want) < 1e-3


def test_merge(spark):
    a = spark.createDataFrame([("k1", 0.5), ("k2", 0.9), ("t", 0.3)], "key string, score double")
    b = spark.createDataFrame([("k1", 0.8), ("k3", 0.1), ("t", 0.3)], "key string, score double")
    assert [tuple(r) for r in search.merge_results([a, b], 4).collect()] == [("k2", 0.9, 0), ("k1", 0.8, 1), ("t", 0.3, 0), ("k3", 0.1, 1)]


def test_batch_equals_single(spark):
    x = np.random.default_rng(1).standard_normal((60, 8)).astype(np.float32)
    d = spark.createDataFrame([(f"vec:{i:02}", [float(v) for v in r], False, 0) for i, r in enumerate(x)] + [("vec:n", None, False, 0), ("vec:short", [1.0], False, 0), ("vec:zero", [0.0] * 8, False, 0)], VEC)
    for metric in V.METRICS:
        got = {}
        for r in search.batch_top_k(d, d, 4, metric).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r.key, r.score))
        for q in ("vec:00", "vec:17"):
            assert got[q] == [tuple(r) for r in search.search_by_key(d, q, k=4, metric=metric).collect()]
    assert search.batch_top_k(d.limit(0), d, 3).count() == 0


def test_batch_neither_copies_nor_loses_rows(spark, monkeypatch):
    # Small blocks: each block of queries meets several batches of the corpus, among them ties, copies, two dimensions and a vector that isn't finite.
    monkeypatch.setattr(search, "QUERY_BLOCK", 64)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((300, 8)), np.ones((40, 8))]).astype(np.float32)
    rows = [(f"vec:{i:03}", [float(v) for v in r]) for i, r in enumerate(x)] + [(f"vec:s{i}", [float(i), 1.0]) for i in range(5)] + [("vec:nan", [float("nan")] * 8)]
    d = spark.createDataFrame(rows, "key string, vector array<float>").repartition(5)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    out = search.batch_top_k(d, d, 3)
    got = {}
    for r in out.collect():
        got.setdefault(r.query, {})[r["rank"]] = (r.key, r.score)
    assert set(got) == {k for k, _ in rows} - {"vec:nan"} and all(len(v) == 3 for v in got.values())
    for i in range(len(x)):
        near = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:3]
        assert [got[f"vec:{i:03}"][n][0] for n in (1, 2, 3)] == [f"vec:{j:03}" for j in near]
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in p and "FlatMapGroups" not in p  # neither side is copied for the blocks of the other


def test_codes(spark):
    x = [1.0, -1.0, 0.0] + [1.0, -2.0] * 40
    d = spark.createDataFrame([(x, [-v - 0.5 for v in x])], "a array<float>, b array<float>")
    r = d.select(V.sign_code(F.col("a")).alias("c"), V.hamming(V.sign_code(F.col("a")), V.sign_code(F.col("b"))).alias("h"), V.sign_bytes("a").alias("y"), V.bytes_to_vector(V.vector_to_bytes("a")).alias("v")).first()
    bits = "".join(f"{w & 0xFFFFFFFFFFFFFFFF:064b}" for w in r.c)
    assert len(r.c) == 2 and bits[: len(x)].count("1") == sum(v >= 0 for v in x)
    assert r.h == sum((p >= 0) != (-p - 0.5 >= 0) for p in x)
    assert bytes(r.y) == np.packbits(np.array(x) >= 0).tobytes() and list(r.v) == x


def test_estimator_recall(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 64)).astype(np.float32)
    d = spark.createDataFrame([(f"vec:{i}", [float(v) for v in r], False, 0) for i, r in enumerate(x)] + [("vec:none", None, False, 0)], VEC)
    p = quantize.fit(d, "vec:", "l2")
    assert np.allclose(p.matrix @ p.matrix.T, np.eye(64)) and np.allclose(p.centroid, x.astype(float).mean(0), atol=1e-6)
    codes = quantize.encoded(d, p).cache()
    direct = oversampled = 0
    for i in range(10):
        want = set(np.argsort(((x - x[i]) ** 2).sum(1))[:10])
        got = quantize.estimated_search(codes, x[i].tolist(), p, 50).collect()
        rows = [int(r.key[4:]) for r in got]
        direct += len(want & set(rows[:10]))
        oversampled += len(want & set(rows))
    assert direct >= 30 and oversampled >= 50
    assert quantize.fnv1a64(b"") == 0xCBF29CE484222325
    b, n, c = quantize.encode(p.centroid[None].astype(np.float64), p)
    assert n[0] == 0 and c[0] == 1 and not b.any()


KV = [("p:a", "one", 10, True), ("p:b", "two", 20, True), ("p:c", None, 30, False), ("q", "x" * 200_000, 1, None), (None, "z", 1, False)]


def test_scans(spark):
    d = spark.createDataFrame(KV, "key string, value string, ts_ms long, is_worm boolean")
    assert sorted(r.k for r in kv.scan(d, "p:", 2).collect()) == ["p:b", "p:c"]
    assert sorted(r.k for r in kv.scan(d, "p:", 2, "first").collect()) == ["p:a", "p:b"]
    assert kv.prefix_scan(d).count() == 4 and kv.prefix_count(d, "p:").first().n == 3
    with pytest.raises(ValueError):
        kv.scan(d, "p:", 1, "middle")
    assert {(r.key, r.value) for r in kv.bulk_get(d, d.select("key").union(spark.createDataFrame([("no",)], "key string"))).filter("key in ('p:a', 'no')").collect()} == {("p:a", "one"), ("no", None)}
    ok, bad = kv.checked_writes(d, spark.createDataFrame([("p:a",), ("p:c",), ("new",)], "key string"))
    assert sorted(keys(ok)) == ["new", "p:c"] and keys(bad) == ["p:a"]


def test_overlay(spark):
    s = "key string, value string, ts_ms long, is_worm boolean"
    a, b = spark.createDataFrame([("k", "live", 2, False)], s), spark.createDataFrame([("k", "old", 1, True), ("f", "frozen", 1, True), ("f", "frozen", 1, True)], s)
    assert {(r.key, r.value, r.layer) for r in kv.overlay([a, b]).collect()} == {("k", "live", 0), ("f", "frozen", 1)}


def test_chat(spark):
    d = spark.createDataFrame([("r", f"chat:r:{i:03}", "u") for i in range(60)] + [("r", "chat:r:059", "u"), ("s", "chat:s:1", None)], "room string, key string, username string")
    assert kv.chat_latest(d).groupBy("room").count().filter("room = 'r'").first()["count"] == 50
    assert [r.key for r in kv.chat_latest(d, 2, "r").orderBy("place").collect()] == ["chat:r:058", "chat:r:059"]


def test_memory(spark):
    v = spark.createDataFrame([("n", "a", [1.0, 0.0], True, 1), ("n", "b", [0.0, 1.0], False, 2), ("n", "c", [0.9, 0.1], False, 3), ("m", "x", [1.0, 0.0], False, 4)], memory.VECS)
    m = spark.createDataFrame([("n", "a", '{"level":1}', 1), ("n", "c", '{"level":3}', 1)], memory.META)
    b = spark.createDataFrame([("n", "a", "héllo wörld", 1), ("n", "z", "body", 9)], memory.DOCS)
    got = memory.query(v, m, b, "n", [1.0, 0.0], 3, snippet_bytes=2).collect()
    assert [(r.id, r.text) for r in got] == [("a", "h"), ("c", None), ("b", None)]
    assert [r.id for r in memory.query(v, m, b, "n", [1.0, 0.0], 3, where="level<=1").collect()] == ["a"]
    assert [r.id for r in memory.query(v, m, b, "n", [1.0, 0.0], 2, min_score=0.995).collect()] == ["a"]
    assert {(r.kind, r.id) for r in memory.orphans(v, b, None, "n").collect()} == {("missing_body", "b"), ("missing_body", "c"), ("missing_vector", "z")}
    assert memory.time_range(v, m, "n", 1, 2, 0).count() == 2
    with pytest.raises(memory.MemoryProblem):
        memory.time_range(v, m, "n", 1, 2, 10_001)
    batch = spark.createDataFrame([("n", "new", [1.0, 2.0], 5)], "ns string, id string, vector array<float>, ts_ms long")
    assert memory.add_bulk(v, batch).count() == 5
    with pytest.raises(memory.MemoryProblem):
        memory.add_bulk(v, batch.union(batch))
    out, counts = memory.drop({"v": v}, "n")
    assert out["v"].count() == 2 and tuple(counts.first()) == ("v", 2, 1)
    with pytest.raises(memory.MemoryProblem):
        memory.reset_index(v, "n")
    c = memory.configured("n", "e")
    assert memory.configured("n", "e", tau_hours=5.0, existing=c).tau_hours == 5.0
    with pytest.raises(memory.MemoryProblem):
        memory.configured("n", "other", existing=c)
    assert abs(np.linalg.norm(memory.hash_embedding("some words here")) - 1) < 1e-6 and memory.hash_embedding(None)[0] == 1
    e = spark.createDataFrame([("n", "i", 5, '{"a":"b","ns":"q"}')], "ns string, id string, ts long, meta string").select(memory.added_event(*[F.col(x) for x in ("ns", "id", "ts", "meta")]).alias("e")).first().e
    assert '"a":"b"' in e and '"ns":"n"' in e


def test_snapshots_and_segments(spark, tmp_path):
    s = "key string, value string, ts_ms long, is_worm boolean"
    d = spark.createDataFrame([(f"k{i:02}", "v", i, i == 3) for i in range(20)], s)
    assert tables.read_snapshot(spark, str(tmp_path)).count() == 0
    tables.write_snapshot(d, str(tmp_path), now_ms=5)
    tables.write_segment(d, f"{tmp_path}/v9/data")  # no marker: not there yet
    assert tables.snapshot_versions(spark, str(tmp_path)) == [5]
    base = tables.read_snapshot(spark, str(tmp_path))
    assert base.count() == 20
    feed = spark.createDataFrame([(1, 1, "set", "k00", "new", False, 100), (2, 2, "delete", "k01", None, None, 100), (3, 3, "delete", "k03", None, None, 100)], "arrival_no long, lsn long, record_type string, key string, value string, is_worm boolean, timestamp long")
    got = {r.key: r.value for r in tables.compact(base, feed).collect()}
    assert len(got) == 19 and got["k00"] == "new" and "k01" not in got and "k03" in got
    seg = spark.createDataFrame([(1, 5, "p")], "table_id int, key long, payload string")
    assert tables.segment_lookup(seg, spark.createDataFrame([(1, 5), (1, 6)], "table_id int, key long")).filter("payload is null").count() == 1
    with pytest.raises(Exception, match="table_id"):
        tables.segment_lookup(seg, spark.createDataFrame([(32, 5)], "table_id int, key long")).collect()
    plan = tables.read_snapshot(spark, str(tmp_path)).filter(F.col("key").startswith("k0"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,k0)" in plan


def test_feed_files(spark, tmp_path):
    assert feed_files.crc32c(b"123456789") == 0xE3069283
    data = feed_files.frame("set", b"k", b"v", True, 7) + feed_files.frame("delete", b"k") + feed_files.frame("vinsert", b"a", ts_ms=3, namespace=b"n:", metric=b"l2") + feed_files.frame("vdelete", b"a", namespace=b"n:")
    (tmp_path / "a.wal").write_bytes(data + b"\x01\x02")
    (tmp_path / "empty.wal").write_bytes(b"")
    rows = feed_files.read_feed_files(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.record_type, r.key, r.value, r.is_worm, r.timestamp, r.namespace, r.metric) for r in rows] == [("set", "k", "v", True, 7, None, None), ("delete", "k", None, None, None, None, None), ("vinsert", "a", None, False, 3, "n:", "l2"), ("vdelete", "a", None, None, None, "n:", None)]
    bad = bytearray(data)
    bad[20] ^= 1
    with pytest.raises(feed_files.Corruption):
        list(feed_files.frames(bytes(bad)))


def test_derived_messages(spark):
    from karst.streaming import bus

    d = spark.createDataFrame([("vInsert ", "vec:n:1", 1), ("vdelete", "vec:n:1", 2), ("set", "mem:n:1", 3), ("set", "mem:n:1:meta", 4), ("SET", "chat:lobby:5:ab", 5), ("set", "kv:1", 6), ("set", None, 7), (None, "vec:n:1", 8)], "record_type string, key string, timestamp long")
    assert [r.channel for r in bus.derived(d).orderBy("ts_ms").collect()] == ["vec:n:inserted", "vec:n:deleted", "mem:n:added", "chat:lobby"]


def test_access(spark):
    d = spark.createDataFrame([("get", "mem:n:1"), ("get", "mem:x:1"), ("set", "mem:n:1"), ("get", None)], "op string, key string")
    got = d.select(access.allows(access.namespace_capabilities("n"), "op", "key").alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False]
    assert [len(access.namespace_capabilities("n", m)) for m in ("read", "write", "readwrite")] == [6, 10, 16]


def test_registry(spark):
    assert len(REGISTRY) == 52
    with pytest.raises(ValueError):
        register("scan")(lambda c: None)
    c = tables.Catalog(spark)
    with pytest.raises(KeyError):
        call(c, "nothing")
    call(c, "kv_put", key="a", value="5", now_ms=1)
    call(c, "kv_put", key="b", value="7", now_ms=1)
    assert call(c, "increment", key="a", now_ms=2, delta="4").first().value == "9"
    assert call(c, "transfer", src="a", dst="b", amount=3, now_ms=3).first().refused is None
    assert call(c, "transfer", src="a", dst="b", amount=300, now_ms=3).first().refused == "insufficient_funds"
    assert {r.k: r.v for r in call(c, "scan", prefix="").collect()} == {"a": "6", "b": "10"}
    call(c, "kv_put", key="w", value="1", now_ms=1, worm=True)
    assert call(c, "kv_put", key="w", value="2", now_ms=2).first().outcome == "worm"
    v = spark.createDataFrame([("vec:a", [1.0, 0.0], False, 1), ("vec:b", [0.9, 0.1], True, 1), ("vec:c", [], False, 1)], VEC)
    assert {r.key: r.outcome for r in call(c, "vinsert", rows=v).collect()} == {"vec:a": "inserted", "vec:b": "inserted", "vec:c": "empty"}
    with pytest.raises(ValueError, match="has metric"):
        call(c, "vinsert", rows=v, metric="l2")
    assert keys(call(c, "vsearch", key="vec:a", k=1)) == ["vec:b"]
    assert {r.key: r.outcome for r in call(c, "vdelete", keys=v.select("key")).collect()} == {"vec:a": "deleted", "vec:b": "worm", "vec:c": "missing"}
    call(c, "mem_init", ns="n", embedder="e")
    rows = spark.createDataFrame([("d1", "text one", '{"k":1}', [1.0, 0.0], 1), ("d2", "text two", None, [0.0, 1.0], 2)], "id string, text string, meta string, vector array<float>, ts_ms long")
    assert call(c, "mem_add", ns="n", rows=rows).count() == 2
    assert [r.id for r in call(c, "mem_query", ns="n", embedding=[1.0, 0.0], k=1, where="k=1").collect()] == ["d1"]
    assert call(c, "mem_get", ns="n", ident="d2").first().meta is None
    assert call(c, "append_log_claim", log_id="l", task="t", by="me", hlc=1, lease_ms=100, now_ms=10).first().winner == "me"
    assert call(c, "append_log_claim_status", log_id="l", task="t", now_ms=500).first().state == "expired"
    assert call(c, "append_log_claim_release", log_id="l", task="t", by="me", outcome="applied", now_ms=600).first().state == "released"
    assert call(c, "append_log_verify", log_id="l").first().problem is None
    call(c, "append_log_checkpoint", log_id="l", from_seq=1, to_seq=3, seed=bytes(32), now_ms=9)
    assert call(c, "append_log_proof_verify", log_id="l", bundle=call(c, "append_log_proof_bundle", log_id="l")).count() == 0
    call(c, "append_log_witness", log_id="l", seed=bytes(32), now_ms=9)
    assert call(c, "append_log_witness_verify", log_id="l").first().valid
