"""Task, trust, presence, clock and ledger folds."""

import random

import pytest
from pyspark.sql import functions as F

from karst.operators import folds

NONE = dict.fromkeys(("at_ms", "by", "hlc", "lease_ms", "winner", "winner_hlc", "granted_seq", "lease_expires_ms", "stale_seq"))


def event(seq, kind, **f):
    return {"log_id": "l", "task": "t", "seq": seq, "kind": kind, **NONE, **f}


def R(seq, by, hlc):
    return event(seq, "request", by=by, hlc=hlc)


def G(seq, winner, expires=999999, at=0):
    return event(seq, "grant", winner=winner, lease_expires_ms=expires, at_ms=at)


@pytest.mark.parametrize(
    ("events", "now", "expected"),
    [
        ([], 1000, {"state": "open", "requests": 0}),
        ([R(1, "a", 0x20), R(2, "b", 0x10)], 5, {"candidate": "b", "candidate_seq": 2}),
        ([R(1, "a", 0x10), R(2, "b", 0x10)], 5, {"candidate": "a", "candidate_seq": 1}),
        ([R(1, "a", 0x10), G(2, "a", 5000), R(3, "b", 5)], 4000, {"state": "claimed", "winner": "a", "candidate": None}),
        ([R(1, "a", 0x10), G(2, "a", 5000), R(3, "b", 5)], 6000, {"state": "expired", "candidate": "b", "candidate_seq": 3}),
        ([R(1, "a", 1), G(2, "a"), event(3, "release", by="x")], 500, {"state": "claimed"}),
        ([R(1, "a", 1), G(2, "a"), event(3, "release", by="a")], 500, {"state": "released", "requests": 0}),
        ([R(1, "a", 1), G(2, "a"), event(3, "release", by="a"), R(4, "b", 2)], 500, {"state": "released", "candidate": "b", "requests": 1}),
        ([R(1, "a", 1), G(2, "a", 200), event(3, "superseded", stale_seq=99)], 150, {"state": "claimed"}),
        ([R(1, "a", 1), G(2, "a", 200), event(3, "superseded", stale_seq=2)], 150, {"state": "open", "epoch": 3}),
        ([R(1, "a", 1), G(2, "a"), G(3, "b", at=101)], 500, {"winner": "a", "grant": 2}),
        ([R(1, "a", 1), G(2, "a", 200), R(3, "b", 2), G(4, "b", at=300)], 500, {"state": "claimed", "winner": "b", "grant": 4}),
    ],
)
def test_task_corpus(events, now, expected):
    s = folds.TaskFold()
    for e in events:
        s = s.step(e)
    names = ("state", "winner", "grant", "granted", "expires", "candidate", "candidate_seq", "requests", "epoch")
    got = dict(zip(names, s.state(now)))
    assert {k: got[k] for k in expected} == expected


def random_tasks(seed):
    r = random.Random(seed)
    rows = []
    for seq in range(1, 200):
        rows.append({**event(seq, r.choice(["open", "request", "request", "request", "grant", "release", "superseded", "noise"])), "task": r.choice(["t1", "t2", None]), "at_ms": seq * 10, "by": r.choice("abc"), "winner": r.choice("abc"), "hlc": r.randint(0, 9), "lease_expires_ms": seq * 10 + r.randint(-50, 400), "stale_seq": seq - r.randint(1, 9)})
    return rows


def test_fold_streams_in_any_order_of_rows(spark):
    rows = random_tasks(3)
    want = {}
    for t in ("t1", "t2"):
        s = folds.TaskFold()
        for e in rows:
            if e["task"] == t and e["kind"] != "noise":
                s = s.step(e)
        want[t] = s.state(1500)
    random.Random(1).shuffle(rows)
    names = [c.split()[0] for c in folds.TASK_EVENT.split(", ")]
    d = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], folds.TASK_EVENT)
    assert {r.task: tuple(r)[2:] for r in folds.task_states(d, 1500).collect()} == want
    assert folds.task_states(d.limit(0), 1).count() == 0


def test_decoding(spark):
    d = spark.createDataFrame([("l", 1, 5, '{"t":"claim.request","task":"t","by":"a","hlc":"0000000000000010","lease_ms":9}'), ("l", 2, 5, "not json"), ("l", 3, 5, '{"t":"other","task":"t"}'), ("l", 4, 5, None), ("l", 5, 5, '{"t":"claim.grant","task":"t","winner":"a","winner_hlc":"10","granted_seq":1,"lease_expires_ms":9,"hlc":"zz"}')], "log_id string, seq long, ingest_ms long, payload string")
    assert [(r.seq, r.kind, r.by, r.hlc) for r in folds.decode_task_events(d).collect()] == [(1, "request", "a", 16), (5, "grant", None, 0)]


TRUST = "seq long, kind string, from_org string, to_org string, cap_bits int, prefixes array<string>, granted_at_ms long, expires_at_ms long, grant_seq long, revoked_at_ms long"


def test_trust(spark):
    g = lambda seq, to, exp=None, org="A": (seq, "grant", org, to, 3, ["kv:", "vec:faq:"], 0, exp, None, None)
    v = lambda seq, of, to, org="A": (seq, "revoke", org, to, None, None, None, None, of, 1)
    d = spark.createDataFrame([g(1, "x"), g(1, "x"), v(2, 1, "x"), g(3, "x"), v(1, 3, "x"), g(5, "y", 50), g(6, "y", 500), g(7, "z", org="B"), v(9, 6, "y", "B"), g(10, None)], TRUST)
    got = folds.trust_capabilities(d, "A", 100)
    assert sorted(r.grant_seq for r in got.collect()) == [3, 6]
    assert sorted(r.grant_seq for r in folds.trust_capabilities(d, None, 100).collect()) == [3, 6, 7]
    ask = spark.createDataFrame([("x", 1, "kv:a"), ("x", 4, "kv:a"), ("x", 2, "vec:faq:9"), ("x", 1, "kv"), ("x", 1, None), ("q", 1, "kv:a")], "org string, bits int, key string")
    assert sorted((r.org, r.bits, r.key) for r in folds.authorized(ask, got).collect()) == [("x", 1, "kv:a"), ("x", 2, "vec:faq:9")]


def test_presence(spark):
    e = spark.createDataFrame([(1, 10, '{"by":"a"}'), (2, 30, '{"by":"b"}'), (3, 5, '{"by":"a"}'), (4, 9, "x"), (5, 9, '{"by":""}'), (6, 9, None)], "seq long, ingest_ms long, payload string")
    assert [(r.by, r.last_seen_ms) for r in folds.agents(e).collect()] == [("a", 10), ("b", 30)]
    s = spark.createDataFrame([("n", 1, "alive"), ("n", 2, "suspected"), ("n", 3, "alive"), ("n", 4, "dead"), ("n", 5, "dead"), ("m", 1, "left")], "node string, ts_ms long, state string")
    assert [(r.ts_ms, r.change) for r in folds.transitions(s).orderBy("ts_ms").collect()] == [(2, "suspect"), (3, "recover"), (4, "dead")]


def test_clock(spark):
    r = random.Random(2)
    walls = [r.randint(100, 120) for _ in range(50)]
    d = folds.hybrid_clock(spark.createDataFrame([("n", i, w) for i, w in enumerate(walls)], "node string, seq long, wall_ms long")).orderBy("seq").collect()
    last = 0
    for row, w in zip(d, walls):
        last = max(w << 16, last + 1)
        assert row.hlc == last
    assert folds.observe(5, 10, 1 << 60) == (10 + folds.MAX_AHEAD_MS << 16) + 1


def test_ledger(spark):
    rows = [("b", 1, None, "x", 100), ("b", 2, None, "y", 0), ("b", 3, "x", "y", 60), ("b", 4, "x", "y", 60), ("b", 5, "x", "x", 1), ("b", 6, "x", "q", 1), ("b", 7, "y", "x", 0), ("b", 8, "y", "x", None)]
    d = spark.createDataFrame(rows, "book string, seq long, src string, dst string, amount long")
    out = folds.transfers(d)
    assert [r.refused for r in out.orderBy("seq").collect()] == [None, None, None, "insufficient_funds", "same account", "no account", "amount", "amount"]
    assert {r.account: r.balance for r in folds.balances(out).collect()} == {"x": 40, "y": 60}


def test_longest_prefix(spark):
    k = spark.createDataFrame([("vec:a:b:1", 1), ("vec:a:2", 2), ("x", 3), (None, 4)], "key string, n int")
    ns = spark.createDataFrame([("vec:",), ("vec:a:",), ("vec:a:b:",)], "ns string")
    assert {r.n: r.ns for r in folds.longest_prefix(k, ns).collect()} == {1: "vec:a:b:", 2: "vec:a:"}
    assert folds.longest_prefix(k, ns.limit(0)).filter(F.col("ns").isNotNull()).count() == 0
