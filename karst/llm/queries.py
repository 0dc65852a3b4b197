"""Queries of the language-model problems, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm import clusters, mixture, neighbours, pii, spam, tokens
from karst.runtime import written


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vector"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_items(table(spark, d, "chat_history"), table(spark, d, "name_list")).select("key", "kind", "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "chat_history"), table(spark, d, "name_list"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.tight_clusters(table(spark, d, "vector_ops"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.describe(table(spark, d, "vector_ops"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ids of each document spell its text."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = tokens.decode_ids(tokens.encode_texts(t), name="spelt")
    return ids.select("doc_id", F.octet_length("spelt").alias("bytes"), F.sha2("spelt", 256).alias("sha256"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """For each source that is wanted, whether the mixture keeps its rules and the report says what is in it."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    m = written(mixture.mix(docs, targets), "mixture")
    per = m.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("last"), F.first("n_tokens").alias("t"), F.first("actual_share").alias("share"))
    per = per.groupBy("source").agg(F.max("n").alias("most"), F.bool_and(F.col("n") == F.col("last")).alias("numbered"), F.sum(F.col("n") * F.col("t")).alias("got"), F.first("share").alias("share"))
    all_ = per.agg(F.sum("got").alias("all"))
    d = mixture.shares(docs, targets).join(per.crossJoin(all_), "source", "left")  # one row on the right
    none = F.col("got").isNull()
    return d.select(
        "source",
        F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("within_repeats"),
        F.coalesce("numbered", F.lit(True)).alias("copies_numbered"),
        (F.coalesce("got", F.lit(0)) == F.col("tokens")).alias("tokens_reported"),
        F.when(none, F.col("actual_share") == 0).otherwise((F.abs(F.col("got") / F.col("all") - F.col("actual_share")) < 1e-9) & (F.abs(F.col("share") - F.col("actual_share")) < 1e-9)).alias("share_reported"),
        (F.col("tokens") <= F.col("available_tokens") * F.col("max_repeats")).alias("within_available"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_documents(table(spark, d, "documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.scored(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_redacted, p4_found, p4_clusters, p6_ids, p6_text, p7_mix, p7_shares, p7_rules, p8_found, p8_scores)}

_USABLE = """
with c as (select key, regexp_extract(key, '^(.*:)', 1) as ns, {op} as op, arg_max(coalesce({vector}, []), ts_ms) as v from {table} where key is not null group by key),
l as (select * from c where len(v) > 0 and op <> 'delete'),
dims as (select ns, len(v) as n, count(*) as c from l group by 1, 2),
usual as (select ns, n from (select *, row_number() over (partition by ns order by c desc, n) as rn from dims) where rn = 1),
u as (select l.ns, l.key, l.v::double[] as v from l join usual on l.ns = usual.ns and len(l.v) = usual.n
      where list_bool_and(list_transform(l.v, lambda x: isfinite(x))) and list_bool_or(list_transform(l.v, lambda x: x <> 0))),
p as (select a.ns, a.key as a, b.key as b, round(list_cosine_similarity(a.v, b.v), 9) as cos from u a join u b on a.ns = b.ns and a.key <> b.key),
e as (select * from p where cos >= 0.80)
"""

# Pivots by the greedy order, one key after the other; members to the closest pivot, of equal ones to the earlier; then the greatest mean cosines.
_GREEDY = (
    _USABLE.format(op="arg_max(op, ts_ms)", vector="vector", table="vector_ops").replace("with c as", "with recursive c as", 1)
    + """, o as (select ns, key, row_number() over (partition by ns order by substr(sha256(key), 1, 15), key) as i from u),
before as (select a.ns, a.i, list(b.i) as near from e join o a on a.key = e.a join o b on b.key = e.b where b.i < a.i group by 1, 2),
step as (select ns, 0::bigint as i, []::bigint[] as heads from (select distinct ns from o)
  union all select s.ns, s.i + 1, case when list_has_any(coalesce(b.near, []), s.heads) then s.heads else list_append(s.heads, s.i + 1) end
  from step s join o on o.ns = s.ns and o.i = s.i + 1 left join before b on b.ns = s.ns and b.i = s.i + 1),
heads as (select s.ns, unnest(s.heads) as i from step s join (select ns, max(i) as n from o group by 1) m on m.ns = s.ns and m.n = s.i),
head as (select o.ns, o.key, o.i from o join heads h on h.ns = o.ns and h.i = o.i),
member as (select ns, key, key as hk from head union all
  select e.ns, e.a, arg_min(head.key, (-e.cos, head.i)) as hk from e join head on head.key = e.b where e.a not in (select key from head) group by 1, 2),
score as (select m.ns, m.hk, m.key, round(avg(case when m.key = n.key then 1.0 else list_cosine_similarity(x.v, y.v) end), 9) as score
  from member m join member n on n.ns = m.ns and n.hk = m.hk join u x on x.key = m.key join u y on y.key = n.key group by 1, 2, 3),
place as (select *, row_number() over (partition by ns, hk order by score desc, key) as rn, count(*) over (partition by ns, hk) as size from score)
select ns as namespace, hk as "pivot", size, max(key) filter (rn = 1) as medoid, list(key order by rn) filter (rn <= 3) as typical from place group by 1, 2, 3"""
)

ORACLE = {
    "p4_clusters": _GREEDY,
    "p6_text": "select doc_id, octet_length(encode(coalesce(text, ''))) as bytes, sha256(coalesce(text, '')) as sha256 from documents",
    "p7_rules": "select source, true as within_repeats, true as copies_numbered, true as tokens_reported, true as share_reported, true as within_available from mix_targets where source is not null and target_share > 0 group by source",
    "p1_found": _USABLE.format(op="''", vector="vector", table="vector")
    + ", t as (select *, row_number() over (partition by a order by cos desc, b) as rn from e) select distinct least(a, b) as key_a, greatest(a, b) as key_b from t where rn <= 10",
    "p4_found": _USABLE.format(op="arg_max(op, ts_ms)", vector="vector", table="vector_ops")
    + """, deg as (select ns, a, count(*) as n, least(a, min(b)) as first from e group by 1, 2),
m as (select ns, first, count(*) as size, min(n) as lo, max(n) as hi from deg group by 1, 2)
select deg.first as cluster_key, deg.a as key from deg join m on deg.ns = m.ns and deg.first = m.first
where m.size >= 3 and m.lo = m.size - 1 and m.hi = m.size - 1""",
}
