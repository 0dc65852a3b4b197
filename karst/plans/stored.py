"""Queries of what writes and reads back: segments, snapshots, catalogs, memory, checkpoints, claims and channels, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions import access, ed25519
from karst.functions import vectors as V
from karst.operators import folds, kv, log, memory, mmr, proofs, search
from karst.operators.changes import record_kind
from karst.plans import reference as ref
from karst.plans.problems import _REPLAY
from karst.plans.reference import _COS, _E, _KV, _M, _ROOTS, _TASKS, DAY0, DIM, NOW, entries, memory_tables, ms, parts_kv, table
from karst.registry import call
from karst.runtime import new_path, written
from karst.sources import tables
from karst.streaming import bus

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- keys and values ------------------------------------------------------------------------------------------------------


@query(f"with {_KV}, x as (select key, value from k where starts_with(key, 'part:Brand#2') order by key desc limit 50) select key, value, row_number() over (order by key) - 1 as place from x")
def scan_ordered(spark, d):
    """The last rows of a prefix with the places in which they come out."""
    rows = kv.prefix_scan(parts_kv(spark, d), "part:Brand#2", 50).select("key", "value")
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query(f"with {_KV} select key, value, ts_ms from k where p_partkey = 1")
def kv_get_point(spark, d):
    k = parts_kv(spark, d)
    row = k.filter("p_partkey = 1").select("key").first()
    return kv.get(k, row.key if row else "").select("key", "value", "ts_ms")


@query(f"with {_KV} select count(*) as keys, count(*) filter (is_worm) as worm, sum(octet_length(encode(key)) + octet_length(encode(value)))::bigint as bytes from k")
def kv_status(spark, d):
    c = tables.Catalog(spark)
    c.put("kv", parts_kv(spark, d).drop("p_partkey"))
    return c.status()


@query(f"with {_KV} select key, case when is_worm and p_partkey % 2 = 0 then 'worm' when p_partkey % 2 = 0 then 'written' end as written, case when p_partkey % 3 <> 0 then null when is_worm then 'worm' else 'deleted' end as deleted, case when p_partkey % 3 = 0 and not is_worm then null when p_partkey % 2 = 0 and not is_worm then 'new' else value end as value from k")
def kv_commands(spark, d):
    """Sets of every second key, deletes of every third, then all keys got."""
    k = parts_kv(spark, d)
    c = tables.Catalog(spark)
    c.put("kv", k.drop("p_partkey"))
    wrote = c.set(k.filter("p_partkey % 2 = 0").select("key", F.lit("new").alias("value"), "ts_ms", F.lit(False).alias("is_worm"))).withColumnRenamed("outcome", "written")
    gone = c.delete(k.filter("p_partkey % 3 = 0").select("key")).withColumnRenamed("outcome", "deleted")
    return c.get(k.select("key")).join(wrote, "key", "left").join(gone, "key", "left").select("key", "written", "deleted", "value")


@query("select 'r:' || r_name as key, 1 as writes, case when r_regionkey % 2 = 0 then 2 else 0 end as reads, (select count(*) from region) as all_writes, (select 2 * count(*) from region where r_regionkey % 2 = 0) as all_reads from region")
def kv_stats(spark, d):
    """Puts and gets by name, and the counters they leave."""
    c = tables.Catalog(spark)
    for r in table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect():  # five rows
        call(c, "kv_put", key=f"r:{r.r_name}", value="x", now_ms=NOW + r.r_regionkey)
        for _ in range(0 if r.r_regionkey % 2 else 2):
            call(c, "kv_get", key=f"r:{r.r_name}", now_ms=NOW)
    all_ = call(c, "kv_stats").select(F.col("writes").alias("all_writes"), F.col("reads").alias("all_reads"))
    return kv.counters(c.read("kv_ops")).select("key", "writes", "reads").join(all_, F.lit(True))


@query("select 'chat:lobby:' || (1000 + r_regionkey) || ':' || r_regionkey as key, lower(r_name) as username, 'hello ' || r_name as text, r_regionkey + 1 as place from region")
def chat_sent(spark, d):
    c = tables.Catalog(spark)
    for r in table(spark, d, "region").select("r_regionkey", "r_name").collect():  # five rows
        call(c, "chat_send", room="lobby", username=r.r_name.lower(), text=f"hello {r.r_name}", now_ms=1000 + r.r_regionkey, suffix=str(r.r_regionkey))
    return call(c, "chat_history", room="lobby").select("key", "username", "text", "place")


# -- tables on disk -------------------------------------------------------------------------------------------------------


@query(f"with {_KV} select key, value, ts_ms, is_worm from k where starts_with(key, 'part:Brand#2')")
def segment_prefix(spark, d):
    path = new_path(spark, "segment")
    tables.write_segment(parts_kv(spark, d).drop("p_partkey"), path)
    return kv.prefix_scan(tables.read_segment(spark, path), "part:Brand#2")


@query("with w as (select p_partkey % 32 as t, p_partkey as key, p_name from part) select case when key % 5 = 0 then (t + 1) % 32 else t end as table_id, key, case when key % 5 = 0 then null else p_name end as payload from w where key % 3 = 0")
def segment_lookups(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 32).cast("int").alias("table_id"), F.col("p_partkey").alias("key"), F.col("p_name").alias("payload"))
    path = new_path(spark, "segment")
    tables.write_segment(p, path, ["table_id", "key"])
    wanted = p.filter("key % 3 = 0").select(F.when(F.col("key") % 5 == 0, (F.col("table_id") + 1) % 32).otherwise(F.col("table_id")).alias("table_id"), "key")
    return tables.segment_lookup(tables.read_segment(spark, path, "table_id int, key long, payload string"), wanted)


@query(f"with {_KV} select 'newest' as version, key, upper(value) as value from k where p_partkey % 2 = 0 union all select 'older', key, value from k")
def snapshot_versions(spark, d):
    """The newest complete snapshot of three, of which the last has no marker, and the one before."""
    k, root = parts_kv(spark, d).drop("p_partkey"), new_path(spark, "snapshots")
    tables.write_snapshot(k, root, now_ms=1000)
    even = parts_kv(spark, d).filter("p_partkey % 2 = 0").drop("p_partkey").withColumn("value", F.upper("value"))
    tables.write_snapshot(even, root, now_ms=2000)
    tables.write_segment(k.withColumn("value", F.lit("lost")), f"{root}/v3000/data")
    newest, older = tables.read_snapshot(spark, root), tables.read_snapshot(spark, root, version=1000)
    return newest.select(F.lit("newest").alias("version"), "key", "value").unionByName(older.select(F.lit("older").alias("version"), "key", "value"))


@query(
    _REPLAY.replace("\ns as (", "\nbase as (select key, min(\"timestamp\") - 1000 as ts from wal where key is not null group by key having count(*) % 2 = 0 union all select 'only:' || r_name, 5 from region),\ns0 as (", 1)
    .replace("\no as (select *,", "\ns as (select * from s0 union all select key, -1, 'base', ts, false, false from base),\no as (select *,", 1)
    + "select key, value, ts as ts_ms, worm as is_worm from o where rn = 1 and not dead"
)
def snapshot_compacted(spark, d):
    """A snapshot with a feed on top."""
    wal = table(spark, d, "wal")
    base = wal.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("t")).filter("n % 2 = 0").select("key", F.lit("base").alias("value"), (F.col("t") - 1000).alias("ts_ms"), F.lit(False).alias("is_worm"))
    more = table(spark, d, "region").select(F.concat(F.lit("only:"), "r_name").alias("key"), F.lit("base").alias("value"), F.lit(5).cast("long").alias("ts_ms"), F.lit(False).alias("is_worm"))
    return tables.compact(base.unionByName(more), wal)


@query("with w as (select arrival_no, case lower(trim(record_type)) when 'del' then 'delete' else lower(trim(record_type)) end as op, key from wal) select arrival_no, coalesce((op = 'set' and starts_with(key, 'kv:')) or (op = 'delete' and key = 'kv:none') or starts_with(key, 'vec:'), false) as allowed from w")
def capability_filter(spark, d):
    caps = [access.Capability("set", "prefix", "kv:"), access.Capability("delete", "exact", "kv:none"), access.Capability("*", "prefix", "vec:")]
    w = table(spark, d, "wal").withColumn("op", record_kind(F.col("record_type")))
    return w.select("arrival_no", access.allows(caps, "op", "key").alias("allowed"))


# -- vectors --------------------------------------------------------------------------------------------------------------


@query(f"with {_E} select key, round(1 - {_COS}, 6) as cosine, round(-list_dot_product(v, qv), 6) as dot, round(list_distance(v, qv) ** 2, 6) as l2 from e, q")
def vector_distances(spark, d):
    q = V.vector_literal(ref.first_vector(spark, d))
    return entries(spark, d).select("key", *[F.round(V.distance(m, F.col("vector"), q), 6).alias(m) for m in ("cosine", "dot", "l2")])


@query(f"with {_E} select key, list_sum(list_transform(v, lambda x: case when x - 0.05 >= 0 then 1 else 0 end))::int as ones from e")
def centered_codes(spark, d):
    code = V.sign_code(F.col("vector"), F.array_repeat(F.lit(0.05), DIM))
    return entries(spark, d).select("key", F.aggregate(code, F.lit(0), lambda s, w: s + F.bit_count(w)).alias("ones"))


@query(f"with {_E} select key, {4 * DIM} as bytes, true as same, true as cut_is_null from e")
def vector_bytes(spark, d):
    b = entries(spark, d).select("key", "vector", V.vector_to_bytes("vector").alias("b"))
    return b.select("key", F.octet_length("b").alias("bytes"), (V.bytes_to_vector("b") == F.col("vector")).alias("same"), V.bytes_to_vector(F.expr("substring(b, 1, 7)")).isNull().alias("cut_is_null"))


@query(f"with {_E}, p as (select a.v, b.v as qv from e a, e b where a.vec_id = 1 and b.vec_id = 2) select 'l2' as metric, round(list_distance(v, qv), 6) as score from p union all select 'unknown', round({_COS}, 6) from p union all select 'dot', round(list_dot_product(v, qv), 6) from p")
def vsim_two(spark, d):
    """An unknown metric is cosine; l2 is the distance itself."""
    e = entries(spark, d)
    parts = [search.similarity_of_pair(e, "vec:1", "vec:2", m).select(F.lit(m).alias("metric"), "score") for m in ("l2", "unknown", "dot")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(ref._top(_COS, k=100))
def vsearch_auto(spark, d):
    """The mode that picks a way by itself is exact; a k beyond 100 is cut to 100."""
    return search.search_by_key(entries(spark, d), "vec:0", k=1000, mode="auto")


@query(
    "with c as (select key, arg_max(coalesce(vector, []), ts_ms) as v from vector where key is not null and ts_ms is not null group by key),"
    " u as (select key, v::double[] as v from c where len(v) > 0 and list_bool_and(list_transform(v, lambda x: isfinite(x))) and list_bool_or(list_transform(v, lambda x: x <> 0))),"
    " s as (select a.key as query, b.key as key, round(list_cosine_similarity(a.v, b.v), 6) as score from u a join u b on len(a.v) = len(b.v) and a.key <> b.key),"
    " r as (select *, row_number() over (partition by query order by score desc, key) as rank from s) select query, key, score, rank from r where rank <= 3"
)
def vsearch_batch_vectors(spark, d):
    """The three most similar current vectors of each, exactly, over all namespaces."""
    v = table(spark, d, "vector").filter("key is not null and ts_ms is not null").groupBy("key").agg(F.max_by(F.coalesce("vector", F.array().cast("array<float>")), "ts_ms").alias("vector"))
    usable = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.filter((F.size("vector") > 0) & F.coalesce(usable, F.lit(False)))
    return search.batch_top_k(v, v, 3)


# -- memory ---------------------------------------------------------------------------------------------------------------


@query(f"select vec_id::varchar as id, 'label ' || label as text, '{{\"label\":' || label || '}}' as meta, {DAY0} + vec_id * 3600000 as ts_ms from embeddings")
def mem_added(spark, d):
    """A namespace set up and filled by name, in batches of the size that is allowed, then read back."""
    c = tables.Catalog(spark)
    call(c, "mem_init", ns="labels", embedder="e")
    e = entries(spark, d).select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("label "), "label").alias("text"), F.to_json(F.struct("label")).alias("meta"), "vector", "ts_ms", F.lit(False).alias("is_worm"))
    parts = -(-e.count() // (memory.BULK_MOST // 2)) or 1
    for i in range(parts):
        call(c, "mem_add", ns="labels", rows=e.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).drop("is_worm"))
    return memory.fetch(c.read("mem_docs", memory.DOCS), c.read("mem_meta", memory.META), "labels")


@query(f"select vec_id::varchar as id, '{{\"ns\":\"labels\",\"id\":\"' || vec_id || '\",\"ts\":\"' || ({DAY0} + vec_id * 3600000) || '\",\"label\":\"' || label || '\"}}' as event from embeddings")
def mem_added_events(spark, d):
    ident = F.col("vec_id").cast("string")
    return entries(spark, d).select(ident.alias("id"), memory.added_event(F.lit("labels"), ident, F.col("ts_ms"), F.to_json(F.struct("label", F.lit("x").alias("id")))).alias("event"))


@query(f"with {_M} select id, case when id::bigint % 2 = 0 then '{{\"changed\":true}}' else meta end as meta, case when id::bigint % 2 = 0 then {NOW} else ts_ms end as ts_ms from p union all select vec_id::varchar, '{{\"changed\":true}}', {NOW} from embeddings where vec_id % 2 = 0 and vec_id::varchar not in (select id from p)")
def mem_meta_changed(spark, d):
    """Metadata of every second id, among them ids that have neither body nor vector."""
    vecs, meta, docs = memory_tables(spark, d)
    ids = vecs.select("id").union(docs.select("id")).distinct().filter("cast(id as bigint) % 2 = 0").union(spark.createDataFrame([("nobody",), ("none",)], "id string"))
    changes = ids.select(F.lit("parts").alias("ns"), "id", F.lit('{"changed":true}').alias("meta"), F.lit(NOW).alias("ts_ms"))
    return memory.set_meta(meta, docs, vecs, changes).select("id", "meta", "ts_ms")


@query("select 'vecs' as name, count(*) filter (vec_id % 7 <> 0) as deleted, count(*) filter (vec_id % 7 = 0) as skipped from embeddings union all select 'docs', count(*), 0 from part union all select 'meta', count(*), 0 from part")
def mem_dropped(spark, d):
    vecs, meta, docs = memory_tables(spark, d)
    other = docs.withColumn("ns", F.lit("other"))
    return memory.drop({"vecs": vecs, "docs": docs.unionByName(other), "meta": meta}, "parts")[1]


@query("select 'x' || vec_id as id from embeddings where label % 2 = 1")
def mem_index_reset(spark, d):
    v = entries(spark, d).select(F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("ns"), F.concat(F.lit("x"), "vec_id").alias("id"), "vector", F.lit(False).alias("is_worm"), "ts_ms")
    return memory.reset_index(v, "even").select("id")


@query("select unnest(['cosine', 'dot', 'l2']) as metric, 10000 as max_bulk, 10000 as max_range")
def mem_capabilities(spark, d):
    c = call(tables.Catalog(spark), "mem_capabilities").select(F.from_json("capabilities", "metrics array<string>, max_bulk int, max_range int").alias("c"))
    return c.select(F.explode("c.metrics").alias("metric"), "c.max_bulk", "c.max_range")


# -- logs -----------------------------------------------------------------------------------------------------------------

SEED = bytes(range(32))


def _first_log(spark, d) -> tuple[DataFrame, str, int]:
    """The chain of the user with the smallest number, its name and length."""
    user = table(spark, d, "events").agg(F.min("user_id").alias("u")).first().u
    chain = written(log.build_chain(ref.log_rows(spark, d).filter(F.col("log_id") == f"user-{user}")), "chain")
    return chain, f"user-{user}", chain.count()


_FIRST = "(select 'user-' || min(user_id) from events)"


@query(f"{_ROOTS} select log_id, 1 as from_seq, leaf_count as to_seq, upper(root) as root, true as valid, false as valid_changed, true as chained from root where log_id = {_FIRST}")
def log_checkpoint(spark, d):
    """A signed checkpoint of a log and one after it; a changed one isn't valid."""
    chain, name, n = _first_log(spark, d)
    first = proofs.checkpoint(chain, name, 1, 1, SEED, NOW, NOW)
    c = proofs.checkpoint(chain, name, 1, n, SEED, NOW, NOW, first.record_hash("karst"))
    row = (name, 1, n, bytes(c.root).hex().upper(), c.valid("karst"), replace(c, to_seq=n + 1).valid("karst"), c.previous == first.record_hash("karst"))
    return spark.createDataFrame([row], "log_id string, from_seq int, to_seq long, root string, valid boolean, valid_changed boolean, chained boolean")


@query("select * from (values ('changed', 0, 'signature'), ('broken', 2, 'record'), ('broken', 3, 'missing record'), ('broken', 4, 'missing proof'), ('broken', 5, 'leaf'), ('broken', 6, 'proof')) t(bundle, seq, problem)")
def bundle_problems(spark, d):
    """A bundle as it is has no problem; with a changed record, lost parts, foreign leaves and another proof it has those; a changed checkpoint has a wrong signature."""
    chain, name, n = _first_log(spark, d)
    c = proofs.checkpoint(chain, name, 1, n, SEED, NOW, NOW)
    records, p = (written(x, "bundle") for x in proofs.bundle_parts(chain, c))
    seq, other = F.col("seq"), F.unhex(F.sha2(F.lit("other"), 256))
    bad_records = records.filter("seq <> 3").withColumn("envelope", F.when(seq == 2, F.concat("envelope", F.lit(bytearray(b"x")))).otherwise(F.col("envelope")))
    bad_proofs = p.filter("seq <> 4").withColumns({"leaf_hash": F.when(seq == 5, other).otherwise(F.col("leaf_hash")), "proof": F.when(seq == 6, F.lit(bytearray(b"none"))).otherwise(F.col("proof"))})
    runs = {"whole": (records, p, c), "changed": (records, p, replace(c, created_ms=1)), "broken": (bad_records, bad_proofs, c)}
    out = None
    for k, parts in runs.items():
        x = proofs.verify_parts(*parts).select(F.lit(k).alias("bundle"), F.col("seq").cast("int").alias("seq"), "problem")
        out = x if out is None else out.unionByName(x)
    return out.filter("bundle <> 'broken' or seq <> 5 or problem = 'leaf'")


@query("select * from (values ('own', true), ('other checkpoint', false), ('changed', false), ('other signer', true)) t(witness, valid)")
def witnesses(spark, d):
    chain, name, n = _first_log(spark, d)
    c, other = proofs.checkpoint(chain, name, 1, n, SEED, NOW, NOW), proofs.checkpoint(chain, name, 1, n - 1, SEED, NOW, NOW)
    w = proofs.witness(c, SEED[::-1], NOW)
    rows = [("own", w.valid(c, "karst")), ("other checkpoint", w.valid(other, "karst")), ("changed", replace(w, observed_ms=1).valid(c, "karst")), ("other signer", proofs.witness(c, bytes(32), NOW).valid(c, "karst"))]
    return spark.createDataFrame(rows, "witness string, valid boolean")


@query(f"with {_KV} select action, mine, theirs from (select 'none' as action, count(*) as mine, count(*) as theirs from k union all select 'tail', count(*), (select count(*) from k where key <= 'part:Brand#3') from k union all select 'full', count(*), count(*) filter (p_partkey % 2 = 0) from k)")
def sync_plans(spark, d):
    """Equal tables, the first rows of mine, and every second row."""
    k = parts_kv(spark, d)
    mine = k.drop("p_partkey")
    parts = [mmr.sync_plan(mine, t) for t in (mine, mine.filter("key <= 'part:Brand#3'"), k.filter("p_partkey % 2 = 0").drop("p_partkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- claims and trust -----------------------------------------------------------------------------------------------------


@query(f"with recursive {_TASKS} select log_id, task, candidate as winner, candidate_seq as granted_seq from state where candidate is not null")
def claims_to_grant(spark, d):
    return folds.grants_to_make(ref.task_events(spark, d), NOW)


@query(f"with recursive {_TASKS}, a as (select task, 'user-' || u as by, o as outcome from state, range(5) t(u), (values ('applied'), ('blocked'), ('other')) v(o)) select 'tasks' as log_id, a.* from a join state s on s.task = a.task and s.winner = a.by and a.outcome <> 'other'")
def claims_released(spark, d):
    """Of releases by everyone with three outcomes, those that are allowed."""
    states = written(folds.task_states(ref.task_events(spark, d), NOW), "states")
    asks = states.select("log_id", "task", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda u: F.concat(F.lit("user-"), u))).alias("by"))
    asks = asks.withColumn("outcome", F.explode(F.array(F.lit("applied"), F.lit("blocked"), F.lit("other"))))
    return folds.may_release(states, asks)


@query(f"with recursive {_TASKS} select 'tasks' as log_id, e.task, e.seq as stale_seq from ev e join state s on s.task = e.task where e.kind = 'grant' and (e.at + coalesce(e.k, 0) * 60000 <= {NOW} or s.grant_seq is distinct from e.seq)")
def claims_superseded(spark, d):
    """Of superseding every event, those that are allowed: grants that have run out or aren't current."""
    e = ref.task_events(spark, d)
    return folds.may_supersede(e, e.select("log_id", "task", F.col("seq").alias("stale_seq")), NOW)


@query("select event_id as seq, case event_type when 'purchase' then 'grant' when 'error' then 'release' when 'signup' then 'superseded' when 'click' then 'open' else 'request' end as kind, 'task-' || (user_id % 40) as task, coalesce(json_extract_string(props, '$.k')::bigint, 0) as hlc, case when event_type in ('purchase', 'signup', 'click') then null else 'u' || user_id end as by from events where user_id % 9 <> 0")
def task_decode(spark, d):
    """Payloads as logs hold them, clocks in hexadecimal text; every ninth user writes something else."""
    e = table(spark, d, "events")
    k, task, by = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)), F.concat(F.lit("task-"), F.col("user_id") % 40), F.concat(F.lit("u"), F.col("user_id"))
    forms = {"purchase": folds.task_payload("claim.grant", task=task, winner=by, winner_hlc=k, granted_seq=1, lease_expires_ms=2, hlc=k), "error": folds.task_payload("claim.release", task=task, by=by, outcome="applied", hlc=k), "signup": folds.task_payload("task.superseded", task=task, stale_seq=3, hlc=k), "click": folds.task_payload("task.open", task=task, hlc=k)}
    payload = folds.task_payload("claim.request", task=task, by=by, hlc=k, lease_ms=5)
    for kind, x in forms.items():
        payload = F.when(F.col("event_type") == kind, x).otherwise(payload)
    payload = F.when(F.col("user_id") % 9 == 0, F.concat(F.lit('{"t":"other","task":"'), task, F.lit('"}'))).otherwise(payload)
    rows = e.select(F.lit("l").alias("log_id"), F.col("event_id").alias("seq"), ms().alias("ingest_ms"), payload.alias("payload"))
    return folds.decode_task_events(rows).select("seq", "kind", "task", "hlc", "by")


@query("select 'table' as source, seq, false as sig_ok from (select distinct seq from trust_log where seq is not null) union all select 'own', r_regionkey, r_regionkey % 2 = 0 from region")
def trust_signatures(spark, d):
    """The table's signatures are random bytes; grants that are signed here hold, unless they are changed afterwards."""
    t = ref.trust(spark, d).filter("seq is not null").dropDuplicates(["seq"])
    public = ed25519.public_key(SEED).hex()
    rows = []
    for r in table(spark, d, "region").select("r_regionkey").collect():  # five rows
        n = r.r_regionkey
        sig = ed25519.sign(SEED, proofs.grant_bytes(bytes.fromhex(public), bytes(32), 3, ["kv:"], 0, n))
        rows.append((n, "grant", public, bytes(32).hex(), 3 if n % 2 == 0 else 7, ["kv:"], n, 0, None, None, bytearray(sig)))
    own = spark.createDataFrame(rows, "seq long, kind string, from_org string, to_org string, cap_bits int, prefixes array<string>, granted_at_ms long, expires_at_ms long, grant_seq long, revoked_at_ms long, sig binary")
    check = lambda x, name: proofs.with_signature_check(x).select(F.lit(name).alias("source"), "seq", "sig_ok")
    return check(t, "table").unionByName(check(own, "own"))


@query(f"with {ref._TRUST} select count(*) filter (kind is distinct from 'grant' or f is distinct from (select min(f) from t)) as invalid_events from t")
def trust_invalid(spark, d):
    """Rows that count for nothing where only grants of one organisation are taken as signed."""
    t = ref.trust(spark, d)
    org = t.agg(F.min("from_org").alias("o")).first().o
    return folds.invalid_events(t, org or "", F.col("kind") == "grant")


# -- channels -------------------------------------------------------------------------------------------------------------


def _published(spark, d) -> str:
    folder = new_path(spark, "messages")
    e = table(spark, d, "events").select(F.col("event_type").alias("channel"), F.col("props").alias("message"), ms().alias("ts_ms"))
    for part in (F.col("ts_ms") % 2 == 0, F.col("ts_ms") % 2 != 0):  # two publications
        bus.publish(e.filter(part), folder)
    return folder


@query("select event_type as channel, props as message, (epoch_us(ts) // 1000) as ts_ms from events where event_type = 'purchase' and json_extract_string(props, '$.k')::double <= 30")
def pubsub_delivered(spark, d):
    """What is published reaches a subscriber once, also one that comes later."""
    return ref._run(bus.subscribe(spark, _published(spark, d), "purchase", "k<=30"), "delivered")


@query("select count(distinct event_type) as channels, count(*) as publishes from events")
def bus_counters(spark, d):
    return bus.counters(spark, spark.read.schema(bus.MESSAGE).parquet(_published(spark, d))).select("channels", "publishes")


@query(f"with s as (select user_id as node, (epoch_us(ts) // 1000) as ts_ms, {ref._STATE} as state, lag({ref._STATE}) over (partition by user_id order by (epoch_us(ts) // 1000), {ref._STATE}) as before from events), c as (select node, ts_ms, state, case state when 'alive' then 'recover' when 'suspected' then 'suspect' else state end as change from s where before is not null and before <> state) select 'cluster:presence' as channel, '{{\"event\":\"' || change || '\",\"node\":' || node || ',\"state\":\"' || state || '\"}}' as message, ts_ms from c")
def presence_channel(spark, d):
    return bus.presence_messages(ref.presence_transitions(spark, d))


@query("select 'mem:' || source || ':added.bulk' as channel, '{\"namespace\":\"' || source || '\",\"count\":' || count(*) || '}' as message, 5 as ts_ms from documents where source is not null group by source")
def bulk_channel(spark, d):
    n = table(spark, d, "documents").filter("source is not null").groupBy(F.col("source").alias("ns")).agg(F.count(F.lit(1)).alias("count"))
    return bus.bulk_messages(n.withColumn("ts_ms", F.lit(5)))


