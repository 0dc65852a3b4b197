"""Queries of the engine's own operators over the driver's tables, and their SQL.

Keys: ``embeddings`` are the vectors ``vec:<vec_id>``, ``part`` the documents of a memory namespace (id p_partkey, body p_name,
metadata of the other columns), ``events`` are change feed, logs, messages and clocks, ``orders`` the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions import vectors as V
from karst.functions.predicate import predicate
from karst.functions.ranks import running
from karst.operators import folds, kv, log, memory, mmr, proofs, quantize, search
from karst.operators.intervals import org_hex
from karst.runtime import new_path, written
from karst.streaming import bus

NOW = 1_706_745_600_000  # 2024-02-01
DAY0 = 1_704_067_200_000  # 2024-01-01
DIM = 64
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("vec:"), "vec_id").alias("key"), F.col("embedding").alias("vector"), (F.lit(DAY0) + F.col("vec_id") * 3_600_000).alias("ts_ms"), (F.col("vec_id") % 7 == 0).alias("is_worm"), "vec_id", "label")


def ms(c: str = "ts"):
    return F.unix_millis(c)


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The query vector of the single searches: vec_id 0, or nothing known (zeros) where there is none."""
    row = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row.embedding) if row else [0.0] * DIM


_E = "e as (select 'vec:' || vec_id as key, embedding::double[] as v, {day} + vec_id * 3600000 as ts_ms, vec_id, label from embeddings), q as (select v as qv from e where vec_id = 0)".format(day=DAY0)
_COS = "list_cosine_similarity(v, qv)"


def _top(score: str, where: str = "vec_id <> 0", k: int = 10) -> str:
    return f"with {_E} select key, round({score}, 6) as score from e, q where {where} order by score desc, key limit {k}"


# -- vector search --------------------------------------------------------------------------------------------------------


@query(_top(_COS))
def vsearch_exact_cosine(spark, d):
    return search.search_by_key(entries(spark, d), "vec:0", k=10)


@query(_top("list_dot_product(v, qv)"))
def vsearch_exact_dot(spark, d):
    return search.search_by_key(entries(spark, d), "vec:0", k=10, metric="dot")


@query(_top("1 / (1 + list_distance(v, qv) ** 2)"))
def vsearch_exact_l2(spark, d):
    return search.search_by_key(entries(spark, d), "vec:0", k=10, metric="l2")


@query(_top(f"0.7 * {_COS} + 0.3 * exp(-greatest({NOW} - ts_ms, 0) / 3600000.0 / 168)", k=25))
def vsearch_decay(spark, d):
    return search.search_by_key(entries(spark, d), "vec:0", k=25, decay=0.3, now_ms=NOW, tau_hours=168.0)


@query(f"with {_E} select a.key as a, b.key as b, round(list_cosine_similarity(a.v, b.v), 6) as cosine, round(list_distance(a.v, b.v), 6) as l2, round(list_dot_product(a.v, b.v), 6) as dot from e a join e b on b.vec_id = a.vec_id + 1")
def vsim_pairs(spark, d):
    e = entries(spark, d)
    a, b = e.select(F.col("key").alias("a"), F.col("vector").alias("x"), (F.col("vec_id") + 1).alias("n")), e.select(F.col("key").alias("b"), F.col("vector").alias("y"), F.col("vec_id").alias("n"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "n").select("a", "b", F.round(V.cosine(x, y), 6).alias("cosine"), F.round(F.sqrt(V.l2_squared(x, y)), 6).alias("l2"), F.round(V.dot(x, y), 6).alias("dot"))


@query(f"with {_E}, s as (select a.key as query, b.key as key, round(list_cosine_similarity(a.v, b.v), 6) as score from e a, e b where a.key <> b.key), r as (select *, row_number() over (partition by query order by score desc, key) as rank from s) select query, key, score, rank from r where rank <= 5")
def vsearch_batch_topk(spark, d):
    e = entries(spark, d).select("key", "vector")
    return search.batch_top_k(e, e, 5)


@query(f"with {_E}, s as (select key, round({_COS}, 6) as score, vec_id from e, q where vec_id <> 0), l as (select *, 0 as source from s where vec_id % 2 = 0 or vec_id % 5 = 0 union all select *, 1 from s where vec_id % 2 = 1), t as (select *, row_number() over (partition by source order by score desc, key) as rn from l), m as (select key, max(score) as score, arg_min(source, (-score, source)) as source from t where rn <= 10 group by key) select key, score, source from m order by score desc, key limit 10")
def vsearch_merge_sources(spark, d):
    e, q = entries(spark, d), first_vector(spark, d)
    parts = [e.filter("vec_id % 2 = 0 or vec_id % 5 = 0"), e.filter("vec_id % 2 = 1")]
    return search.merge_results([search.search(p, q, 10, exclude="vec:0") for p in parts], 10, "vec:0")


_HAM = "1 - list_sum(list_transform(list_zip(v, qv), lambda z: case when (z[1] >= 0) <> (z[2] >= 0) then 1 else 0 end)) / 64.0"


@query(_top(_HAM))
def bq_hamming_topk(spark, d):
    """The coarse score itself."""
    e, q = entries(spark, d), V.vector_literal(first_vector(spark, d))
    score = V.hamming_similarity(V.sign_code(F.col("vector")), V.sign_code(q), F.lit(DIM))
    return search.top_k(e.filter("vec_id <> 0").select("key", F.round(score, 6).alias("score")), 10)


@query(
    f"with {_E}, c as (select key, round(0.8 * ({_COS}) + 0.2 * exp(-greatest({NOW} - ts_ms, 0) / 3600000.0 / 168), 6) as score from (select * from e, q where vec_id <> 0 order by 0.8 * ({_HAM}) + 0.2 * exp(-greatest({NOW} - ts_ms, 0) / 3600000.0 / 168) desc, key limit 200) order by score desc, key limit 10),"
    " x as (select key, round(list_dot_product(v, qv), 6) as score from e, q where vec_id <> 0 order by score desc, key limit 10)"
    " select 'bq' as mode, * from c union all select 'bq_rerank', * from c union all select 'dot with codes', * from x"
)
def vsearch_bq_modes(spark, d):
    """Both modes by sign codes, with decay, and the exact search that a dot product falls back to where other codes are stored."""
    e = entries(spark, d)
    options = {"k": 10, "decay": 0.2, "now_ms": NOW, "tau_hours": 168.0}
    p = quantize.fit(e, "vec:")
    runs = [(m, search.search_by_key(e, "vec:0", mode=m, **options)) for m in ("bq", "bq_rerank")] + [("dot with codes", search.search_by_key(e, "vec:0", k=10, metric="dot", mode="bq", params=p))]
    parts = [r.select(F.lit(m).alias("mode"), "key", "score") for m, r in runs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"with {_E}, c as (select key, v, qv from e, q where vec_id <> 0 order by {_HAM} desc, key limit 200) select key, round({_COS}, 6) as score from c order by score desc, key limit 10")
def bq_two_stage(spark, d):
    return search.search_by_key(entries(spark, d), "vec:0", k=10, mode="bq_rerank")


@query(f"with {_E}, n as (select list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from e), x as (select unnest(range(0, {DIM})) as pos, unnest(u) as y from n) select pos::int as pos, round(avg(y), 6) as mean from x group by 1")
def rabitq_centroid(spark, d):
    return quantize.centroid(entries(spark, d)).select("pos", F.round("mean", 6).alias("mean"))


@query()
def rabitq_estimator_search(spark, d):
    e = entries(spark, d)
    p = quantize.fit(e, "vec:")
    return quantize.estimated_search(quantize.encoded(e, p), first_vector(spark, d), p, 10)


@query(_top(_COS, where="true"))
def rabitq_rerank(spark, d):
    e, q = entries(spark, d), first_vector(spark, d)
    p = quantize.fit(e, "vec:")
    return quantize.estimated_rerank(e, quantize.encoded(e, p), q, p, 10)


@query("select count(*) as vectors, arg_max(len(embedding), 'vec:' || vec_id) as dims, count(*) filter (vec_id % 7 = 0) as worm from embeddings")
def vstats(spark, d):
    return search.vector_stats(entries(spark, d))


@query("with v as (select key, coalesce(len(vector), 0) as n from vector where key is not null), x as (select arg_min(n, key) as dim from v where n > 0) select dim, count(*) filter (n = dim) as inserted, count(*) filter (n <> dim) as skipped from v, x group by dim")
def vreindex_report(spark, d):
    return search.reindex_report(table(spark, d, "vector").filter("key is not null"), "")


@query(f"with {_E}, b as (select vec_id, key, case when vec_id % 11 = 0 then 0 when vec_id % 13 = 0 then 63 else 64 end as n, vec_id % 14 = 0 as frozen from e) select key, case when n = 0 then 'empty' when frozen then 'worm' else 'dimension' end as reason from b where n = 0 or frozen or n <> 64")
def vinsert_rejected(spark, d):
    e = entries(spark, d)
    old = e.filter("vec_id % 2 = 0").select("key", "vector", "is_worm", "ts_ms")
    cut = F.when(F.col("vec_id") % 11 == 0, F.slice("vector", 1, 0)).when(F.col("vec_id") % 13 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector"))
    return search.insert_batch(old, e.select("key", cut.alias("vector"), "is_worm", "ts_ms"))[1].select("key", "reason")


@query("with k as (select distinct 'vec:' || (vec_id * 2) as key, vec_id * 2 as n from embeddings), m as (select max(vec_id) as m from embeddings) select key, case when n > m then 'missing' when n % 7 = 0 then 'worm' else 'deleted' end as outcome from k, m")
def vdelete_outcomes(spark, d):
    e = entries(spark, d)
    return search.delete_keys(e, e.select(F.concat(F.lit("vec:"), F.col("vec_id") * 2).alias("key")))[1]


@query("select count(*) filter (vec_id % 7 <> 0) as deleted, count(*) filter (vec_id % 7 = 0) as skipped from embeddings where starts_with('vec:' || vec_id, 'vec:1')")
def vnsdrop_counts(spark, d):
    return search.drop_namespace(entries(spark, d), "vec:1")[1]


@query("select regexp_extract(key, '^(.*:)', 1) as ns, min(lower(trim(metric))) as metric, count(distinct lower(trim(metric))) as metrics from vector where key is not null group by 1")
def namespace_metrics(spark, d):
    return search.namespace_metrics(table(spark, d, "vector"))


@query(f"with {_E}, s as (select a.key as query, b.key as key, a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as score, {_HAM.replace('v, qv', 'a.v, b.v')} as ham from e a, e b where a.vec_id % 50 = 0 and a.key <> b.key), x as (select *, row_number() over (partition by query order by score desc, key) as r1, row_number() over (partition by query order by ham desc, key) as r2 from s) select query, count(*) filter (r1 <= 10 and r2 <= 100) / 10.0 as recall from x group by query")
def recall_at_k(spark, d):
    e = entries(spark, d)
    q = e.filter("vec_id % 50 = 0").select("key", "vector")
    exact = search.batch_top_k(q, e.select("key", "vector"), 10).groupBy("query").agg(F.collect_list("key").alias("wanted"))
    signs = F.transform("vector", lambda x: F.when(x >= 0, 1.0).otherwise(-1.0).cast("float"))
    code = lambda x: x.select("key", signs.alias("vector"))
    coarse = search.batch_top_k(code(q), code(e), 100, "dot").groupBy("query").agg(F.collect_list("key").alias("found"))
    return exact.join(coarse, "query").select("query", V.recall(F.col("found"), F.col("wanted")).alias("recall"))


# -- documents ------------------------------------------------------------------------------------------------------------


def memory_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, metadata, bodies) of namespace ``parts``; vectors of ids 0 .., parts of ids 5 .., so some have no counterpart."""
    e = entries(spark, d)
    vecs = e.select(F.lit("parts").alias("ns"), F.col("vec_id").cast("string").alias("id"), "vector", "is_worm", "ts_ms")
    p = table(spark, d, "part").withColumns({"ns": F.lit("parts"), "id": (F.col("p_partkey") + 5).cast("string"), "ts_ms": F.lit(DAY0) + F.col("p_partkey") * 1000})
    meta = p.select("ns", "id", F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))).alias("meta"), "ts_ms")
    return vecs, meta, p.select("ns", "id", F.col("p_name").alias("text"), "ts_ms")


_M = f"{_E}, p as (select (p_partkey + 5)::varchar as id, p_size, p_type, p_brand, p_name, {DAY0} + p_partkey * 1000 as ts_ms, '{{\"size\":' || p_size || ',\"type\":\"' || p_type || '\",\"brand\":\"' || p_brand || '\"}}' as meta from part)"
_MQ = f"with {_M}, s as (select vec_id::varchar as id, round(0.9 * {_COS} + 0.1 * exp(-greatest({NOW} - e.ts_ms, 0) / 3600000.0 / 168), 6) as score, e.ts_ms, p.meta, substr(p.p_name, 1, 6) as text from e cross join q join p on p.id = vec_id::varchar where p_size <= 30 and p_type in ('ECONOMY', 'PROMO', 'STANDARD') and e.ts_ms >= {DAY0} order by score desc, id limit 10)"


def _memory_query(spark, d, **options):
    vecs, meta, docs = memory_tables(spark, d)
    return memory.query(vecs, meta, docs, "parts", first_vector(spark, d), 10, 0.1, snippet_bytes=6, now_ms=NOW, where=f"size<=30 AND type IN ('ECONOMY','PROMO',\"STANDARD\") AND ts>={DAY0}", **options)


@query(_MQ + " select * from s")
def mem_query_filtered(spark, d):
    return _memory_query(spark, d)


@query(_MQ + " select * from s where score >= 0.2")
def mem_query_min_score(spark, d):
    return _memory_query(spark, d, min_score=0.2)


@query("select event_id::varchar as id, (epoch_us(ts) // 1000) as ts_ms, props as meta from events where (epoch_us(ts) // 1000) between 1704200000000 and 1704900000000 and json_extract_string(props, '$.k')::double > 40 order by ts_ms, id limit 50")
def mem_range(spark, d):
    e = table(spark, d, "events").select(F.lit("log").alias("ns"), F.col("event_id").cast("string").alias("id"), ms().alias("ts_ms"), F.col("props").alias("meta"))
    return memory.time_range(e, e, "log", 1_704_200_000_000, 1_704_900_000_000, 50, "k>40")


@query(f"with {_M} select id, p_name as text, case when p_partkey % 3 = 0 then null else meta end as meta, ts_ms from (select p.*, id::bigint - 5 as p_partkey from p)")
def mem_get_join(spark, d):
    _, meta, docs = memory_tables(spark, d)
    return memory.fetch(docs, meta.filter("(cast(id as bigint) - 5) % 3 <> 0"), "parts")


@query("with v as (select vec_id::varchar as id from embeddings), p as (select (p_partkey + 5)::varchar as id from part) select 'missing_body' as kind, id from v where id not in (select id from p) union all select 'missing_vector', id from p where id not in (select id from v)")
def mem_orphans(spark, d):
    vecs, _, docs = memory_tables(spark, d)
    return memory.orphans(vecs, docs, None, "parts")


@query("with v as (select vec_id::varchar as id from embeddings), p as (select (p_partkey + 5)::varchar as id from part), o as (select 'missing_body' as kind, id from v where id not in (select id from p) union all select 'missing_vector', id from p where id not in (select id from v)) select kind, count(*) as n, list_sort(list(id))[1:100] as ids, count(*) > 100 as truncated from o group by kind")
def mem_verify(spark, d):
    vecs, _, docs = memory_tables(spark, d)
    return memory.verify(vecs, docs, None, "parts")


@query("select (select count(*) from embeddings) as vectors, (select count(*) from part) as bodies, (select count(*) from part) as metas, (select arg_max(len(embedding), vec_id::varchar) from embeddings) as dims")
def mem_stats(spark, d):
    vecs, meta, docs = memory_tables(spark, d)
    return memory.stats(vecs, docs, meta, "parts")


@query("with v as (select count(*) as vectors, count(*) filter (vec_id % 10 <> 0) as live from embeddings) select vectors, live, greatest(vectors - live, 0) as pending, vectors <= live as caught_up from v")
def mem_health(spark, d):
    vecs = memory_tables(spark, d)[0]
    return memory.health(vecs, vecs.filter("cast(id as bigint) % 10 <> 0"), "parts")


@query("with b as (select vec_id, case when vec_id % 9 = 0 then 'a b' || vec_id when vec_id % 4 = 0 then 'x' || (vec_id // 8) else 'x' || vec_id end as id, case when vec_id % 17 = 0 then 63 else 64 end as n from embeddings), f as (select arg_min(n, id) as dim from b) select distinct id, 'invalid id' as problem from b where id like '% %' union select id, 'duplicate' from b group by id having count(*) > 1 union select id, 'dimension' from b, f where n <> dim union select id, 'exists' from b where id in ('x1', 'x2', 'x3')")
def mem_bulk_validate(spark, d):
    v = F.col("vec_id")
    ident = F.when(v % 9 == 0, F.concat(F.lit("a b"), v)).when(v % 4 == 0, F.concat(F.lit("x"), F.floor(v / 8))).otherwise(F.concat(F.lit("x"), v))
    batch = entries(spark, d).select(F.lit("n").alias("ns"), ident.alias("id"), F.when(v % 17 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector")).alias("vector"), "ts_ms")
    old = spark.createDataFrame([("n", "x1"), ("n", "x2"), ("n", "x3"), ("m", "x5")], "ns string, id string")
    return memory.validate_bulk(batch, old)


@query("with k as (select event_id, ts, json_extract_string(props, '$.k')::double as k from events) select event_id, k >= 50 as numeric, k in (1, 2, 69) as listed, (epoch_us(ts) // 1000) > 1705000000000 as later, false as missing, k = 7 and (epoch_us(ts) // 1000) < 1706000000000 as both from k")
def predicate_columns(spark, d):
    e = table(spark, d, "events")
    p = lambda text: predicate(text, "props", ms())
    return e.select("event_id", p("k>=50").alias("numeric"), p("meta.k IN (1, '2', 69)").alias("listed"), p("ts>1705000000000").alias("later"), p("filter='absent=1'").alias("missing"), p('k="7" AND ts<1706000000000').alias("both"))


_FNV = "list_reduce(list_prepend({1}::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query(
    "with t as (select row_number() over () as n, key, coalesce(text, '') as text from chat_history), w as (select n, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from t),"
    f" b as (select n, {_FNV.format('w', 2166136261)} % 32 as pos, case when {_FNV.format('w', 0x811C9DC5 ^ 0x9E3779B9)} % 2 = 1 then -1.0 else 1.0 end as s from w),"
    " v as (select n, pos, sum(s) as x from b group by 1, 2), l as (select n, sqrt(sum(x * x)) as len from v group by 1),"
    " u as (select n, pos, x / len as x from v join l using (n) where x <> 0 union all select n, 0, 1.0 from t where n not in (select n from b))"
    " select key, pos::int as pos, round(x, 4) as x from u join t using (n)"
)
def hash_embeddings(spark, d):
    """The elements that aren't 0."""
    e = table(spark, d, "chat_history").select("key", F.posexplode(memory.embedder(32)("text")).alias("pos", "x"))
    return e.filter("x <> 0").select("key", "pos", F.round(F.col("x").cast("double"), 4).alias("x"))


# -- keys and values ------------------------------------------------------------------------------------------------------


def parts_kv(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat_ws(":", F.lit("part"), "p_brand", F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("key"), F.col("p_name").alias("value"), (F.lit(DAY0) + F.col("p_partkey")).alias("ts_ms"), (F.col("p_partkey") % 5 == 0).alias("is_worm"), "p_partkey")


_KV = f"k as (select 'part:' || p_brand || ':' || lpad(p_partkey::varchar, 8, '0') as key, p_name as value, {DAY0} + p_partkey as ts_ms, p_partkey % 5 = 0 as is_worm, p_partkey from part)"


@query(f"with {_KV} select key as k, value as v, ts_ms as ts from k where starts_with(key, 'part:Brand#1') order by key desc limit 20")
def scan_prefix_last(spark, d):
    return kv.scan(parts_kv(spark, d), "part:Brand#1", 20)


@query(f"with {_KV} select key as k, value as v, ts_ms as ts from k where starts_with(key, 'part:Brand#1') order by key limit 20")
def scan_prefix_first(spark, d):
    return kv.scan(parts_kv(spark, d), "part:Brand#1", 20, "first")


@query("select count(distinct key) as n from wal where starts_with(key, 'kv:')")
def count_prefix(spark, d):
    return kv.prefix_count(table(spark, d, "wal"), "kv:")


@query("select doc_id::varchar as key, epoch_ms(committed_at) as ts_ms, false as is_worm, octet_length(encode(text)) as bytes, sha256(text) as sha256 from documents")
def entry_metadata(spark, d):
    t = table(spark, d, "documents")
    return kv.entry_metadata(t.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"), F.unix_millis(F.col("committed_at").cast("timestamp")).alias("ts_ms"), F.lit(False).alias("is_worm")))


@query(f"with {_KV} select key, case when p_partkey % 3 = 0 then upper(value) else value end as value, ts_ms, is_worm, case when p_partkey % 3 = 0 then 0 when p_partkey % 2 = 0 then 1 else 2 end as layer from k")
def overlay_merge(spark, d):
    k = parts_kv(spark, d)
    live, mid = k.filter("p_partkey % 3 = 0").withColumn("value", F.upper("value")), k.filter("p_partkey % 2 = 0")
    return kv.overlay([x.drop("p_partkey") for x in (live, mid, k)])


@query(f"with {_KV} select key from k where p_partkey % 10 = 0")
def worm_rejected(spark, d):
    k = parts_kv(spark, d)
    return kv.checked_writes(k, k.filter("p_partkey % 2 = 0"))[1].select("key")


@query("with o as (select user_id as key, case when event_type in ('click', 'view') then 'get' else 'put' end as op, (epoch_us(ts) // 1000) as ts_ms, event_id as seq from events), e as (select key, max(seq) filter (op = 'put') as last_put, min(ts_ms) filter (op = 'put') as created_ms, max(ts_ms) filter (op = 'put') as updated_ms, count(*) filter (op = 'put') as writes from o group by key) select e.key, created_ms, updated_ms, writes, (select count(*) from o where o.key = e.key and op = 'get' and seq > last_put) as reads from e where last_put is not null")
def kv_counters(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type").isin("click", "view"), "get").otherwise("put")
    return kv.counters(e.select(F.col("user_id").alias("key"), op.alias("op"), ms().alias("ts_ms"), F.col("event_id").alias("seq")))


@query("select user_id as key, event_id as seq, (sum(coalesce(try_cast(case when event_id % 10 = 0 then 'x' else (event_id % 7)::varchar end as bigint), 1)) over (partition by user_id order by event_id))::bigint as value from events")
def kv_increments(spark, d):
    e = table(spark, d, "events")
    delta = F.when(F.col("event_id") % 10 == 0, "x").otherwise((F.col("event_id") % 7).cast("string"))
    return kv.increments(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), delta.alias("delta")))


@query("with c as (select distinct room, key from chat_history where room is not null), r as (select *, row_number() over (partition by room order by key desc) as rn from c) select room, key, row_number() over (partition by room order by key) as place from r where rn <= 20")
def chat_history_latest(spark, d):
    return kv.chat_latest(table(spark, d, "chat_history").filter("room is not null"), 20).select("room", "key", "place")


# -- logs -----------------------------------------------------------------------------------------------------------------


def log_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("user-"), "user_id").alias("log_id"), F.col("event_id").alias("ord"), ms().alias("ingest_ms"), F.col("props").alias("payload"), "event_id")


_HEX = "lpad(lower(hex({})), {}, '0')"


@query(f"with x as (select event_id, 'user-' || user_id as log_id, (epoch_us(ts) // 1000) as t, props from events) select event_id, sha256(unhex(hex(encode('WDBALOG1')) || '0001' || {_HEX.format('octet_length(encode(log_id))', 8)} || hex(encode(log_id)) || {_HEX.format('event_id', 16)} || repeat('00', 32) || {_HEX.format('t', 16)} || sha256(props) || '00000000' || {_HEX.format('octet_length(encode(props))', 8)} || hex(encode(props)))) as event_hash from x")
def log_envelope_hash(spark, d):
    x = log_rows(spark, d).withColumns({"seq": F.col("event_id"), "prev_hash": F.lit(bytearray(32)), "payload": F.col("payload").cast("binary"), "attachments": F.array().cast("array<binary>")})
    return log.with_event_hash(x).select("event_id", F.lower(F.hex("event_hash")).alias("event_hash"))


# The chain of each user's events, one step of the recursion per event, and the record hashes of its envelopes (bytes in hex).
_CHAIN = (
    "r as (select 'user-' || user_id as log_id, row_number() over (partition by user_id order by event_id, props) as seq, (epoch_us(ts) // 1000) as t, props from events),"
    f" b as (select log_id, seq, hex(encode('WDBALOG1')) || '0001' || {_HEX.format('octet_length(encode(log_id))', 8)} || hex(encode(log_id)) || {_HEX.format('seq', 16)} as head,"
    f" {_HEX.format('t', 16)} || sha256(props) || '00000000' || {_HEX.format('octet_length(encode(props))', 8)} || hex(encode(props)) as tail from r),"
    " chain as (select log_id, seq, repeat('00', 32) as prev, sha256(unhex(head || repeat('00', 32) || tail)) as hash, sha256(unhex(head || repeat('00', 32) || tail || sha256(unhex(head || repeat('00', 32) || tail)))) as record from b where seq = 1"
    " union all select b.log_id, b.seq, c.hash, sha256(unhex(b.head || c.hash || b.tail)), sha256(unhex(b.head || c.hash || b.tail || sha256(unhex(b.head || c.hash || b.tail)))) from chain c join b on b.log_id = c.log_id and b.seq = c.seq + 1)"
)
_MMR = "hex(encode('karst.proof.mmr.{0}.v1')) || '00'"
# The levels of the trees over them: a node for each full pair below; then the peaks, from the left, and the root.
_ROOTS = (
    f"with recursive {_CHAIN},"
    f" node as (select log_id, 0 as height, seq - 1 as pos, sha256(unhex({_MMR.format('leaf')} || {_HEX.format('seq - 1', 16)} || '0000000000000020' || record)) as hash from chain"
    f" union all select * from (select log_id, height + 1 as height, pos // 2 as pos, sha256(unhex({_MMR.format('parent')} || {_HEX.format('height + 1', 2)} || hash || lead(hash) over (partition by log_id, height order by pos))) as hash, pos as own,"
    " lead(pos) over (partition by log_id, height order by pos) as other from node) x where own % 2 = 0 and other = own + 1),"
    " n as (select log_id, count(*) as leaves from chain group by 1),"
    f" peak as (select n.log_id, leaves, string_agg({_HEX.format('height', 2)} || hash, '' order by height desc) as body, count(*) as peaks from n join node on node.log_id = n.log_id and (leaves >> height) & 1 = 1 and pos = (leaves >> height) - 1 group by 1, 2),"
    f" root as (select log_id, leaves as leaf_count, sha256(unhex({_MMR.format('root')} || {_HEX.format('leaves', 16)} || {_HEX.format('peaks', 16)} || body)) as root from peak)"
).replace("union all select * from (select log_id, height + 1", "union all select log_id, height, pos, hash from (select log_id, height + 1")


@query(f"with recursive {_CHAIN} select log_id, count(*) as events, max(seq) as last_seq, upper(arg_max(hash, seq)) as head_hash from chain group by 1")
def log_chain_report(spark, d):
    return log.log_report(log.build_chain(log_rows(spark, d))).select("log_id", "events", "last_seq", F.hex("head_hash").alias("head_hash"))


@query("with x as (select 'user-' || user_id as log_id, row_number() over (partition by user_id order by event_id) as seq from events) select log_id, seq, 'payload_hash' as problem from x where seq = 3 union all select log_id, 6, 'sequence' from x where seq = 6")
def log_verify_tampered(spark, d):
    """Payloads of every third event changed and every fifth event lost: the first is seen by itself, the second by the gap behind it."""
    chain = log.build_chain(log_rows(spark, d))
    broken = chain.withColumn("payload", F.when(F.col("seq") == 3, F.lit(bytearray(b"other"))).otherwise(F.col("payload"))).filter("seq <> 5")
    return log.verify_chain(broken)


def _tree(spark, d) -> tuple[DataFrame, DataFrame]:
    leaves = written(proofs.record_hashes(log.build_chain(log_rows(spark, d))), "records")
    return mmr.nodes(leaves), leaves


@query(_ROOTS + " select log_id, leaf_count, upper(root) as root from root")
def mmr_roots(spark, d):
    return mmr.roots(_tree(spark, d)[0]).select("log_id", "leaf_count", F.hex("root").alias("root"))


@query("with x as (select 'user-' || user_id as log_id, row_number() over (partition by user_id order by event_id) - 1 as i from events) select log_id, count(*) as proofs, count(*) filter (i % 4 <> 1 and i % 4 <> 2 and i % 4 <> 3) as valid from x group by 1")
def mmr_proofs_valid(spark, d):
    """A proof for every event, checked against its log's root; of each four, one is left as it is, one has a changed leaf, one a changed proof, one another root."""
    tree, leaves = _tree(spark, d)
    p = mmr.proofs(tree, leaves).join(leaves, ["log_id", "leaf_index"]).join(mmr.roots(tree), "log_id")
    kind, other = F.col("leaf_index") % 4, F.unhex(F.sha2("root", 256))
    end = F.length("proof")
    p = p.withColumns({"leaf": F.when(kind == 1, other).otherwise(F.col("leaf")), "proof": F.when(kind == 2, F.concat(F.substring(F.col("proof"), F.lit(1), end - 32), other)).otherwise(F.col("proof")), "root": F.when(kind == 3, other).otherwise(F.col("root"))})
    return mmr.check_proofs(p).groupBy("log_id").agg(F.count(F.lit(1)).alias("proofs"), F.sum(F.col("valid").cast("int")).alias("valid"))


_LEAF = f"sha256(unhex(hex(encode('karst.prefix-root.leaf.v1')) || {_HEX.format('octet_length(encode(key))', 16)} || hex(encode(key)) || {_HEX.format('octet_length(encode(value))', 16)} || hex(encode(value)) || case when is_worm then '01' else '00' end || {_HEX.format('ts_ms', 16)}))"


@query(
    f"with recursive {_KV}, level as (select 0 as h, row_number() over (order by key) - 1 as pos, {_LEAF} as hash, count(*) over () as n from k"
    " union all select h, pos, hash, n from (select h + 1 as h, pos // 2 as pos, case when lead(hash) over (order by pos) is null then hash else sha256(unhex(hex(encode('karst.prefix-root.node.v1')) || hash || lead(hash) over (order by pos))) end as hash, (n + 1) // 2 as n, pos as own from level where n > 1) x where own % 2 = 0)"
    " select (select count(*) from k) as entries, upper(hash) as root from level where n = 1 and pos = 0 order by h desc limit 1"
)
def prefix_root(spark, d):
    return mmr.prefix_root(parts_kv(spark, d).drop("p_partkey"), "part:").select("entries", F.hex("root").alias("root"))


@query(f"with {_KV} select key, case when p_partkey % 7 = 0 then 'only_mine' when p_partkey % 11 = 0 then 'only_theirs' else 'differs' end as status from k where p_partkey % 7 = 0 or p_partkey % 11 = 0 or p_partkey % 13 = 0")
def sync_diff(spark, d):
    k = parts_kv(spark, d)
    mine, theirs = k.filter("p_partkey % 11 <> 0 or p_partkey % 7 = 0"), k.filter("p_partkey % 7 <> 0")
    theirs = theirs.withColumn("value", F.when(F.col("p_partkey") % 13 == 0, "changed").otherwise(F.col("value")))
    return mmr.table_difference(mine, theirs)


# -- folds ----------------------------------------------------------------------------------------------------------------


def task_events(spark, d) -> DataFrame:
    """Claims of tasks by users, from the events: the type gives the kind."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.create_map(*[F.lit(x) for x in ("click", "request", "view", "request", "purchase", "grant", "error", "release", "signup", "superseded")])[F.col("event_type")]
    by = F.concat(F.lit("user-"), F.col("user_id") % 5)
    none = F.lit(None).cast("long")
    return e.select(F.lit("tasks").alias("log_id"), F.col("event_id").alias("seq"), ms().alias("at_ms"), F.concat(F.lit("task-"), F.col("user_id") % 40).alias("task"), F.coalesce(kind, F.lit("request")).alias("kind"), by.alias("by"), k.alias("hlc"), F.lit(60_000).cast("long").alias("lease_ms"), by.alias("winner"), k.alias("winner_hlc"), none.alias("granted_seq"), (ms() + k * 60_000).alias("lease_expires_ms"), none.alias("stale_seq"))


# The state of a task, one step of the recursion per event: epoch, what opened it, the grant, requests and the best ones of the epoch and since the grant.
_TASKS = (
    "ev as (select 'task-' || (user_id % 40) as task, event_id as seq, (epoch_us(ts) // 1000) as at, case event_type when 'purchase' then 'grant' when 'error' then 'release' when 'signup' then 'superseded' else 'request' end as kind,"
    " 'user-' || (user_id % 5) as who, json_extract_string(props, '$.k')::bigint as k from events),"
    " o as (select *, row_number() over (partition by task order by seq) as i from ev),"
    " st as (select task, 0::bigint as i, 0::bigint as epoch, 'open' as base, null::bigint as gseq, null::varchar as winner, null::bigint as expires, 0::bigint as requests,"
    " null::struct(h bigint, s bigint, b varchar) as best, null::struct(h bigint, s bigint, b varchar) as later from (select distinct task from ev)"
    " union all select st.task, o.i, case when rel then o.seq else st.epoch end, case when rel then 'released' else st.base end, case when rel then null when gr then o.seq else st.gseq end, case when rel then null when gr then o.who else st.winner end,"
    " case when rel then null when gr then o.at + coalesce(o.k, 0) * 60000 else st.expires end, case when rel then 0 when rq then st.requests + 1 else st.requests end,"
    " case when rel then null when rq and st.gseq is null then least(coalesce(st.best, me), me) else st.best end,"
    " case when rel or gr then null when rq and st.gseq is not null then least(coalesce(st.later, me), me) else st.later end"
    " from st join o on o.task = st.task and o.i = st.i + 1, lateral (select o.kind = 'release' and st.gseq is not null and o.who = st.winner as rel, o.kind = 'grant' and (st.gseq is null or st.expires <= o.at) as gr, o.kind = 'request' as rq,"
    " {'h': coalesce(o.k, 0), 's': o.seq, 'b': o.who} as me) z),"
    " fin as (select * from st where (task, i) in (select (task, max(i)) from o group by task)),"
    f" state as (select 'tasks' as log_id, task, case when gseq is null then base when expires > {NOW} then 'claimed' else 'expired' end as state, winner, gseq as grant_seq, case when gseq is not null then 0 end as granted_seq, expires as lease_expires_ms,"
    f" case when gseq is null then best.b when expires <= {NOW} then later.b end as candidate, case when gseq is null then best.s when expires <= {NOW} then later.s end as candidate_seq, requests, epoch as epoch_start_seq from fin)"
)


@query(f"with recursive {_TASKS} select * from state")
def task_fold(spark, d):
    return folds.task_states(task_events(spark, d), NOW)


def trust(spark, d) -> DataFrame:
    t = table(spark, d, "trust_log")
    return t.withColumns({"from_org": org_hex(F.col("from_org")), "to_org": org_hex(F.col("to_org")), "kind": F.lower(F.trim("kind"))})


_AT = 1_700_000_000_000
_ORG = "regexp_replace(lower(trim({0})), '^0x', '')"
_TRUST = f"t as (select seq, lower(trim(kind)) as kind, {_ORG.format('from_org')} as f, {_ORG.format('to_org')} as o, cap_bits, prefixes, expires_at_ms, grant_seq from trust_log), g as (select distinct on (seq) * from t where kind = 'grant' and f is not null and o is not null), c as (select * from g where not exists (select 1 from t r where r.kind = 'revoke' and r.grant_seq = g.seq and r.f = g.f and r.o = g.o and r.seq > g.seq) and (coalesce(expires_at_ms, 0) = 0 or expires_at_ms > {_AT}))"


@query(f"with {_TRUST} select seq as grant_seq, f as from_org, o as to_org, cap_bits, expires_at_ms from c")
def trust_fold(spark, d):
    return folds.trust_capabilities(trust(spark, d), None, _AT).select("grant_seq", "from_org", "to_org", "cap_bits", "expires_at_ms")


@query(f"with {_TRUST}, r as (select seq, o as org, 1 as bits, case seq % 3 when 0 then 'kv:a' when 1 then 'vec:faq:1' else 'log:x' end as key from t where o is not null) select distinct r.seq, r.org, r.key from r join c on c.o = r.org and (c.cap_bits & r.bits) = r.bits and list_bool_or(list_transform(c.prefixes, lambda p: starts_with(r.key, p)))")
def trust_authorized(spark, d):
    t = trust(spark, d)
    key = F.when(F.col("seq") % 3 == 0, "kv:a").when(F.col("seq") % 3 == 1, "vec:faq:1").otherwise("log:x")
    r = t.filter("to_org is not null").select("seq", F.col("to_org").alias("org"), F.lit(1).alias("bits"), key.alias("key"))
    return folds.authorized(r, folds.trust_capabilities(t, None, _AT)).select("seq", "org", "key")


@query("with n as (select distinct regexp_extract(key, '^(.*:)', 1) as ns from wal where key is not null union select 'vec:' union select 'kv:'), k as (select distinct key from wal where key is not null) select key, arg_max(ns, length(ns)) as ns from k join n on starts_with(key, ns) where ns <> '' group by key")
def longest_namespace(spark, d):
    k = table(spark, d, "wal").filter("key is not null").select("key").distinct()
    ns = k.select(F.regexp_extract("key", "^(.*:)", 1).alias("ns")).union(spark.createDataFrame([("vec:",), ("kv:",)], "ns string")).filter("ns <> ''")
    return folds.longest_prefix(k, ns)


@query("select 'user-' || user_id as \"by\", max((epoch_us(ts) // 1000)) as last_seen_ms, min(event_id) as first_seq from events where user_id % 4 <> 0 group by 1")
def presence_last_seen(spark, d):
    e = table(spark, d, "events")
    payload = F.when(F.col("user_id") % 4 != 0, F.to_json(F.struct(F.concat(F.lit("user-"), "user_id").alias("by")))).otherwise("not json")
    return folds.agents(e.select(payload.alias("payload"), ms().alias("ingest_ms"), F.col("event_id").alias("seq")))


_STATE = "case event_type when 'click' then 'alive' when 'view' then 'alive' when 'error' then 'suspected' else 'dead' end"


@query(f"with s as (select user_id as node, (epoch_us(ts) // 1000) as ts_ms, {_STATE} as state, lag({_STATE}) over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as before from events) select node, ts_ms, case state when 'alive' then 'recover' when 'suspected' then 'suspect' else state end as change from s where before is not null and before <> state")
def presence_transitions(spark, d):
    state = F.when(F.col("event_type").isin("click", "view"), "alive").when(F.col("event_type") == "error", "suspected").otherwise("dead")
    return folds.transitions(table(spark, d, "events").select(F.col("user_id").alias("node"), ms().alias("ts_ms"), state.alias("state")))


@query("with x as (select user_id as node, event_id as seq, (epoch_us(ts) // 1000) // 3600000 * 3600000 as wall_ms, row_number() over (partition by user_id order by event_id) as i from events) select node, seq, wall_ms, max(wall_ms * 65536 - i) over (partition by node order by seq) + i as hlc from x")
def hlc_assign(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (F.floor(ms() / 3_600_000) * 3_600_000).alias("wall_ms"))
    return folds.hybrid_clock(e)


def ledger_rows(spark, d) -> DataFrame:
    """Each customer's orders move money from the customer's account to one of ten tills, after an opening credit."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    book = F.concat(F.lit("book-"), F.col("o_custkey") % 64)
    acct = lambda x: F.concat(F.lit("acct:"), x)
    amount = F.floor(F.col("o_totalprice")).cast("long")
    moves = o.select(book.alias("book"), (F.col("o_orderkey") + 1_000_000_000).alias("seq"), acct("o_custkey").alias("src"), F.concat(F.lit("till:"), F.col("o_orderkey") % 10).alias("dst"), amount.alias("amount"))
    none = F.lit(None).cast("string")
    opening = c.select(F.concat(F.lit("book-"), F.col("c_custkey") % 64).alias("book"), F.col("c_custkey").alias("seq"), none.alias("src"), acct("c_custkey").alias("dst"), F.lit(1_000_000).cast("long").alias("amount"))
    tills = spark.range(64 * 10).select(F.concat(F.lit("book-"), F.col("id") % 64).alias("book"), (F.col("id") + 900_000_000).alias("seq"), none.alias("src"), F.concat(F.lit("till:"), F.floor(F.col("id") / 64)).alias("dst"), F.lit(0).cast("long").alias("amount"))
    return moves.unionByName(opening).unionByName(tills)


@query("with m as (select 'book-' || (o_custkey % 64) as book, 'till:' || (o_orderkey % 10) as account, floor(o_totalprice)::bigint as amount from orders union all select 'book-' || (o_custkey % 64), 'acct:' || o_custkey, -floor(o_totalprice)::bigint from orders) select book, account, sum(amount)::bigint as balance from m group by 1, 2")
def ledger_net(spark, d):
    return folds.balances(ledger_rows(spark, d).filter("src is not null").withColumn("refused", F.lit(None).cast("string")))


# Balances of a book as a map, one step of the recursion per row.
_LEDGER = (
    "rw as (select 'book-' || (o_custkey % 64) as book, o_orderkey + 1000000000 as seq, 'acct:' || o_custkey as src, 'till:' || (o_orderkey % 10) as dst, floor(o_totalprice)::bigint as amount from orders"
    " union all select 'book-' || (c_custkey % 64), c_custkey, null, 'acct:' || c_custkey, 1000000 from customer"
    " union all select 'book-' || (i % 64), i + 900000000, null, 'till:' || (i // 64), 0 from range(640) t(i)),"
    " nr as (select *, row_number() over (partition by book order by seq) as i from rw),"
    " fold as (select book, 0::bigint as i, null::bigint as seq, null::varchar as src, null::varchar as dst, null::bigint as amount, null::varchar as refused, map([]::varchar[], []::bigint[]) as m from (select distinct book from rw)"
    " union all select f.book, r.i, r.seq, r.src, r.dst, r.amount, why, case when why is not null then f.m when r.src is null then map_concat(f.m, map([r.dst], [coalesce(f.m[r.dst], 0) + r.amount]))"
    " else map_concat(f.m, map([r.src, r.dst], [f.m[r.src] - r.amount, f.m[r.dst] + r.amount])) end from fold f join nr r on r.book = f.book and r.i = f.i + 1,"
    " lateral (select case when r.src is null then null when r.amount <= 0 then 'amount' when r.src = r.dst then 'same account' when f.m[r.src] is null or f.m[r.dst] is null then 'no account' when f.m[r.src] < r.amount then 'insufficient_funds' end as why) z)"
)


@query(f"with recursive {_LEDGER} select book, seq, src, dst, amount, refused from fold where i > 0")
def ledger_transfers(spark, d):
    return folds.transfers(ledger_rows(spark, d))


@query("select 1000000 * (select count(*) from customer) as total")
def ledger_conserved(spark, d):
    return folds.balances(folds.transfers(ledger_rows(spark, d))).agg(F.sum("balance").alias("total"))


# -- streams --------------------------------------------------------------------------------------------------------------


def _stream(spark, d) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path.replace("events.parquet", "events.parque[t]")).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, name: str) -> DataFrame:
    out = new_path(stream.sparkSession, name)
    return bus.run_once(stream, f"{out}/sink", f"{out}/state")


@query("select event_type as channel, props as message, (epoch_us(ts) // 1000) as ts_ms from events where event_type = 'click' and json_extract_string(props, '$.k')::double > 70")
def pubsub_filtered(spark, d):
    e = _stream(spark, d).select(F.col("event_type").alias("channel"), F.col("props").alias("message"), ms().alias("ts_ms"))
    return _run(bus.filtered(e, "click", "k>70"), "pubsub")


_DERIVED = "with r as (select key, lower(trim(record_type)) as t, regexp_extract(key, '^(.*:)', 1) as ns from wal), c as (select case when t = 'vinsert' then ns || 'inserted' when t = 'vdelete' then ns || 'deleted' when t = 'set' and starts_with(key, 'mem:') and not ends_with(key, ':meta') then ns || 'added' when t = 'set' and starts_with(key, 'chat:') then 'chat:' || split_part(key, ':', 2) end as channel from r) select channel, count(*) as messages from c where channel is not null group by 1"


@query(_DERIVED)
def derived_channels(spark, d):
    return bus.derived(table(spark, d, "wal")).groupBy("channel").agg(F.count(F.lit(1)).alias("messages"))



@query("select epoch_ms(time_bucket(interval '1 hour', ts)) as start_ms, epoch_ms(time_bucket(interval '1 hour', ts)) + 3600000 as end_ms, event_type, count(*) as events from events group by all")
def window_counts(spark, d):
    return bus.window_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour")


@query("with w as (select ((epoch_us(ts) // 1000) // 900000 - i) * 900000 as s from events, range(0, 4) t(i)) select s as start_ms, s + 3600000 as end_ms, count(*) as events from w group by all")
def sliding_counts(spark, d):
    return bus.window_counts(table(spark, d, "events"), "ts", [], "1 hour", "15 minutes")


@query("with x as (select user_id, (epoch_us(ts) // 1000) as t, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as n from events), s as (select *, sum(n) over (partition by user_id order by t rows unbounded preceding) as k from x) select min(t) as start_ms, max(t) + 7200000 as end_ms, user_id, count(*) as events from s group by user_id, k")
def session_counts(spark, d):
    return bus.session_counts(table(spark, d, "events"), "ts", ["user_id"], "2 hours")


@query("with w as (select epoch_ms(time_bucket(interval '1 hour', ts)) as start_ms, event_type, count(*) as events from events group by all) select start_ms, start_ms + 3600000 as end_ms, event_type, events from w where start_ms + 3600000 <= (select max(epoch_us(ts) // 1000) from events) - 3600000")
def stream_window_counts(spark, d):
    """The windows that the watermark has closed when the files are read."""
    return _run(bus.window_counts(_stream(spark, d), "ts", ["event_type"], "1 hour"), "windows")


@query("select count(*) as events from events")
def stream_dedup(spark, d):
    e = _stream(spark, d)
    return _run(bus.deduplicated(e, "ts", ["event_id"], "40 days").select("event_id"), "dedup").agg(F.count(F.lit(1)).alias("events"))


@query("select event_type, list_sort(list(value))[least(count(*), floor(count(*) * 0.5)::bigint + 1)] as p50, list_sort(list(value))[least(count(*), floor(count(*) * 0.99)::bigint + 1)] as p99 from events group by 1")
def value_percentiles(spark, d):
    """The elements at floor(n * p) of each type's sorted values: equal values are counted first, and ranks are sums by value bucket, so a type is spread over tasks."""
    e = table(spark, d, "events").filter("value is not null")
    c = e.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    ends = c.groupBy("event_type").agg(F.sum("n").alias("all"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    c = written(c.join(ends, "event_type"), "values")
    bucket = F.floor((F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * 1023)
    r = running(c, ["event_type"], bucket, ["value"], F.col("n"), "upto")
    place = lambda p: F.least(F.col("all") - 1, F.floor(F.col("all") * p))
    at = lambda p: F.max(F.when((F.col("upto") > place(p)) & (F.col("upto") - F.col("n") <= place(p)), F.col("value")))
    return r.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.99).alias("p99"))
