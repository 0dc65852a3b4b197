import pytest
from pyspark.sql import functions as F

from karst.functions.predicate import PredicateError, parse, predicate

A = "privacy_level<=1 AND category=\"semantic\" AND sourceType IN ('chat','tool') AND ts>=1700000000"
META = '{"privacy_level":1,"category":"semantic","sourceType":"chat"}'


@pytest.mark.parametrize(
    ("text", "meta", "ts", "expected"),
    [
        (A, META, 1700000001, True),
        (A, META.replace(":1", ":2"), 1700000001, False),
        (A, META.replace("semantic", "episodic"), 1700000001, False),
        (A, META.replace("chat", "mail"), 1700000001, False),
        (A, META, 1699999999, False),
        ("filter='meta.about=\"user-x\" AND minImportance>0.7'", '{"about":"user-x","minImportance":0.8}', 0, True),
        ("filter='meta.about=\"user-x\" AND minImportance>0.7'", '{"about":"user-y","minImportance":0.8}', 0, False),
        ("privacy_level<=1", '{"nested":{"privacy_level":1}}', 0, False),
        ("privacy_level<=1", '{"nested":{"privacy_level":5},"privacy_level":1}', 0, True),
        ("a=1", '{"a":"1"}', 0, True),
        ('a="1"', '{"a":1}', 0, True),
        ('a="x"', '{"a":true}', 0, False),
        ('a<"b"', '{"a":"a"}', 0, False),
        ("a IN (1, 'x',)", '{"a":"x"}', 0, True),
        ("a=1", None, 0, False),
        ("a=1", "", 0, False),
        ("a=1", "not json", 0, False),
        ("a=1", '{"a":null}', 0, False),
        ("a=1", '{"a":[1]}', 0, False),
        ("ts<5", None, None, False),
        ("a-b='q c'", '{"a-b":"q c"}', 0, True),
        ("a>=1e2", '{"a":100.0}', 0, True),
        ("a>1", '{"a":"' + "x" * 100_000 + '"}', 0, False),
    ],
)
def test_corpus(spark, text, meta, ts, expected):
    d = spark.createDataFrame([(meta, ts)], "meta string, ts long")
    assert d.select(predicate(text, "meta", "ts").alias("p")).first().p is expected


@pytest.mark.parametrize("text", ["", "  ", "a", "a=", "=1", "a=1 OR b=2", "NOT a=1", "a!=1", "(a=1)", "meta.user.name='x'", "a IN 1", "a IN ()", "a IN (1", "a=b", "a=1 AND", "a=1 b=2", "filter=''"])
def test_rejected(text):
    with pytest.raises(PredicateError):
        parse(text)


def test_stays_in_the_jvm(spark):
    d = spark.createDataFrame([(META, 1)], "meta string, ts long").filter(predicate(A, F.col("meta"), F.col("ts")))
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()
