"""Periods and gaps against a merge of sorted intervals."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from karst.operators.intervals import NEVER, coalesce_intervals, org_hex, trust_periods


def by_hand(rows):
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, spans in by.items():
        spans.sort()
        a, b = spans[0]
        for s, e in spans[1:]:
            if s <= b:
                b = max(b, e)
            else:
                out |= {(k, "period", a, b), (k, "gap", b, s)}
                a, b = s, e
        out.add((k, "period", a, 0 if b == NEVER else b))
    return out


def result(spark, rows, bucket=10):
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "k string, s long, e long, rank long, kind string")
    return {(r.k, r.kind, r.start_ms, r.end_ms) for r in coalesce_intervals(d, ["k"], "s", "e", bucket).collect()}


def test_random(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", "hot", "hot", "hot", None]), r.choice([None, *range(0, 400)]), r.choice([None, NEVER, *range(0, 500)]) if r.random() < 0.1 else r.randint(0, 420)) for _ in range(900)]
    rows = [(k, s, e if e is None or e == NEVER or s is None else s + e % 7 - 1) for k, s, e in rows]
    assert result(spark, rows + rows[:50]) == by_hand(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(-20, 20), st.integers(-20, 25)), max_size=12))
def test_any(spark, rows):
    assert result(spark, rows) == by_hand(rows)


def test_edges(spark):
    assert result(spark, []) == set()
    assert result(spark, [("a", 1, 1), ("a", 2, 1)]) == set()
    assert result(spark, [("a", 1, 5), ("a", 5, 9), ("a", 2, 3)]) == {("a", "period", 1, 9)}
    assert result(spark, [("a", 1, NEVER), ("a", 3, 4)]) == {("a", "period", 1, 0)}


def test_trust_rows(spark):
    a, b = "0x" + "AB" * 32, "cd" * 32
    rows = [("grant", a, b + " ", 1, 5, 9), ("Grant ", a.lower(), b.upper(), 2, 9, None), ("revoke", a, b, 3, 1, 2), ("grant", "zz", b, 4, 1, 2), ("grant", a, None, 5, 1, 2), ("grant", a, b, 6, None, 2)]
    d = spark.createDataFrame(rows, "kind string, from_org string, to_org string, seq long, granted_at_ms long, expires_at_ms long")
    assert [tuple(r) for r in trust_periods(d).collect()] == [("ab" * 32, "cd" * 32, "period", 5, 0)]


def test_org(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("\t0X" + "Aa" * 32,), ("x",), (None,)], "o string").select(org_hex(F.col("o")).alias("o"))
    assert [r.o for r in d.collect()] == ["aa" * 32, None, None]
