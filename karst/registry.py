"""Procedures by name (§2.13): functions of a ``Catalog`` that give a DataFrame.

Tables: ``kv``, ``vectors`` (key, vector, is_worm, ts_ms), ``mem_docs``, ``mem_meta``, ``mem_vecs``, ``log`` (``karst.operators.log.EVENT``),
``trust``, ``chat``, ``checkpoints``, ``witnesses``. A procedure that writes replaces the table in the catalog and gives
what it did; the clock and keys are arguments. ``register`` adds a package's own procedures; a name can be taken once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions import access
from karst.functions import vectors as V
from karst.operators import folds, kv, log, memory, mmr, proofs, quantize, search
from karst.runtime import written
from karst.sources.tables import Catalog

Procedure = Callable[..., DataFrame]
REGISTRY: dict[str, Procedure] = {}
CODES = "key string, code binary, code_norm double, code_corr double, ts_ms long"
VECTORS = "key string, vector array<float>, is_worm boolean, ts_ms long"
CHAT = "key string, room string, username string, text string, ts_ms long"


def register(name: str) -> Callable[[Procedure], Procedure]:
    def add(f: Procedure) -> Procedure:
        if name in REGISTRY:
            raise ValueError(f"procedure {name} exists")
        REGISTRY[name] = f
        return f

    return add


def call(catalog: Catalog, name: str, **args) -> DataFrame:
    if name not in REGISTRY:
        raise KeyError(f"no procedure {name}")
    return REGISTRY[name](catalog, **args)


def _row(c: Catalog, schema: str, *values) -> DataFrame:
    return c.spark.createDataFrame([values], schema)


# -- keys and values ----------------------------------------------------------------------------------------------------


OPS = "key string, op string, ts_ms long, seq long"


def _note(c: Catalog, key: str, op: str, now_ms: int) -> None:
    """Counts an operation: counters and the metadata of keys are aggregates over these rows."""
    c.configs["kv_seq"] = seq = c.configs.get("kv_seq", 0) + 1
    c.append("kv_ops", _row(c, OPS, key, op, now_ms, seq))


@register("kv_put")
def kv_put(c, key: str, value: str, now_ms: int, worm: bool = False):
    out = c.set(_row(c, "key string, value string, ts_ms long, is_worm boolean", key, value, now_ms, worm))
    if out.first().outcome == "written":
        _note(c, key, "put", now_ms)
    return out


@register("kv_get")
def kv_get(c, key: str, now_ms: int = 0):
    """The row of a key; an error where there is none. ``meta:<key>`` gives the key's counters as text."""
    if key.startswith("meta:"):
        m = kv.counters(c.read("kv_ops", OPS)).filter(F.col("key") == key[5:])
        out = m.select(F.lit(key).alias("key"), F.format_string("created=%d\nupdated=%d\nwrites=%d\nreads=%d", "created_ms", "updated_ms", "writes", "reads").alias("value"), F.col("updated_ms").alias("ts_ms"), F.lit(False).alias("is_worm"))
    else:
        out = kv.get(c.read("kv"), key)
    if out.isEmpty():
        raise KeyError("key_not_found")
    if not key.startswith("meta:"):
        _note(c, key, "get", now_ms)
    return out


@register("kv_stats")
def kv_stats(c):
    return kv.counter_totals(c.read("kv_ops", OPS))


@register("scan")
def scan(c, prefix: str, limit: int = 100, cut: str = "last"):
    return kv.scan(c.read("kv"), prefix, limit, cut)


@register("increment")
def increment(c, key: str, now_ms: int, delta: str = "1"):
    old = kv.get(c.read("kv"), key).agg(F.first("value").alias("value"))
    new = old.select(F.lit(key).alias("key"), (kv.to_number(F.col("value")) + kv.to_number(F.lit(delta), 1)).cast("string").alias("value"), F.lit(now_ms).cast("long").alias("ts_ms"), F.lit(False).alias("is_worm"))
    new = written(new, "increment")
    c.set(new)
    return new.select("key", "value")


@register("transfer")
def transfer(c, src: str, dst: str, amount: int, now_ms: int):
    have = c.read("kv").filter(F.col("key").isin(src, dst)).select(F.lit("kv").alias("book"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("src"), F.col("key").alias("dst"), F.col("value").try_cast("bigint").alias("amount"))
    rows = have.filter("amount is not null").unionByName(_row(c, "book string, seq long, src string, dst string, amount long", "kv", 1, src, dst, amount))
    out = written(folds.transfers(rows), "transfer")
    if not out.filter("seq = 1 and refused is null").isEmpty():
        new = folds.balances(out).select(F.col("account").alias("key"), F.col("balance").cast("string").alias("value"), F.lit(now_ms).cast("long").alias("ts_ms"), F.lit(False).alias("is_worm"))
        c.set(new)
    return out.filter("seq = 1").select("src", "dst", "amount", "refused")


@register("chat_send")
def chat_send(c, room: str, username: str, text: str, now_ms: int, suffix: str):
    row = _row(c, CHAT, f"chat:{room}:{now_ms}:{suffix}", room, username, text, now_ms)
    c.put("chat", c.read("chat", CHAT).unionByName(row))
    return row


@register("chat_history")
def chat_history(c, room: str, limit: int = 50):
    return kv.chat_latest(c.read("chat", CHAT), limit, room)


# -- vectors ------------------------------------------------------------------------------------------------------------


def _with_codes(c: Catalog, options: dict) -> dict:
    """The options of a search with the stored codes of its namespace, where there are any and its mode reads codes."""
    ns = options.get("ns", "vec:")
    if options.get("mode", "exact").startswith("bq") and f"codes:{ns}" in c.configs:
        return {**options, "params": c.configs[f"codes:{ns}"], "codes": c.read(f"codes:{ns}", CODES)}
    return options


@register("vsearch")
def vsearch(c, key: str, k: int = 10, **options):
    return search.search_by_key(c.read("vectors", VECTORS), key, k=k, **_with_codes(c, options))


@register("vsearch_local_raw")
def vsearch_local_raw(c, vector: list[float], k: int = 10, **options):
    return search.search(c.read("vectors", VECTORS), vector, k=k, **_with_codes(c, options))


@register("vsearch_cluster")
def vsearch_cluster(c, key: str, k: int = 10, sources: tuple[str, ...] = ("vectors",), **options):
    """(key, score, source, partial) over several tables; a table that isn't there is passed over and makes the result ``partial``."""
    partial = F.lit(any(s not in c.tables and s not in c.layers for s in sources)).alias("partial")
    v = kv.get(c.read("vectors", VECTORS), key).select("vector").first()
    if v is None:
        return c.spark.createDataFrame([], "key string, score double, source int").select("*", partial)
    return search.merge_results([search.search(c.read(s, VECTORS), list(v.vector), k=k, **options) for s in sources], search.clamp_k(k), key).select("*", partial)


@register("vsim")
def vsim(c, a: str, b: str, metric: str = "cosine"):
    return search.similarity_of_pair(c.read("vectors", VECTORS), a, b, metric)


@register("vinsert")
def vinsert(c, rows: DataFrame, metric: str = "cosine"):
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    ns = rows.select(F.regexp_extract("key", r"(?s)^(.*:)", 1).alias("ns")).distinct()
    known = c.read("vector_namespaces", "ns string, metric string")
    clash = known.join(ns, "ns").filter(F.col("metric") != metric).first()
    if clash is not None:
        raise ValueError(f"namespace {clash.ns} has metric {clash.metric}")
    c.append("vector_namespaces", ns.join(known, "ns", "left_anti").select("ns", F.lit(metric).alias("metric")))
    old = c.read("vectors", VECTORS)
    ok, bad = search.insert_batch(old, rows)
    ok = written(ok, "inserted")
    c.put("vectors", old.join(ok.select("key"), "key", "left_anti").unionByName(ok.select(old.columns)))
    for name, p in [(n, x) for n, x in c.configs.items() if n.startswith("codes:")]:  # codes follow their vectors
        mine = ok.filter(F.col("key").startswith(name[6:]))
        c.put(name, c.read(name, CODES).join(mine.select("key"), "key", "left_anti").unionByName(_coded(mine, p)))
    c.configs["inserts"] = c.configs.get("inserts", 0) + ok.count()
    return ok.select("key", F.lit("inserted").alias("outcome")).unionByName(bad.select("key", F.col("reason").alias("outcome")))


@register("vdelete")
def vdelete(c, keys: DataFrame):
    rest, out = search.delete_keys(c.read("vectors", VECTORS), keys)
    out = written(out, "outcome")
    c.put("vectors", rest)
    for name in [n for n in c.configs if n.startswith("codes:")]:
        c.put(name, c.read(name, CODES).join(out.filter("outcome = 'deleted'"), "key", "left_anti"))
    return out


@register("vstats")
def vstats(c, ns: str = "vec:"):
    return search.vector_stats(c.read("vectors", VECTORS), ns, c.read(f"codes:{ns}", CODES), c.configs.get("inserts"))


@register("vreindex")
def vreindex(c, ns: str = "vec:"):
    return search.reindex_report(c.read("vectors", VECTORS), ns)


@register("vrabitq")
def vrabitq(c, ns: str, metric: str = "cosine"):
    d = c.read("vectors", VECTORS).filter(F.col("key").startswith(ns))
    p = quantize.fit(d, ns, metric)
    c.configs[f"codes:{ns}"] = p
    c.put(f"codes:{ns}", _coded(d, p))
    return c.read(f"codes:{ns}")


def _coded(d: DataFrame, p: quantize.Params) -> DataFrame:
    return quantize.encoded(d, p).select("key", "code", "code_norm", "code_corr", "ts_ms")


@register("vnsdrop")
def vnsdrop(c, ns: str, purge: bool = False):
    rest, counts = search.drop_namespace(c.read("vectors", VECTORS), ns)
    c.tables.pop(f"codes:{ns}", None)
    c.configs.pop(f"codes:{ns}", None)
    if purge:
        c.put("vectors", rest)
    return counts


@register("auth_mint_scoped")
def auth_mint_scoped(c, ns: str, mode: str = "read"):
    memory.check_names(ns)
    return c.spark.createDataFrame([(x.op, x.match, x.pattern) for x in access.namespace_capabilities(ns, mode)], "op string, match string, pattern string")


# -- logs ---------------------------------------------------------------------------------------------------------------


def _log(c: Catalog) -> DataFrame:
    return c.read("log", log.EVENT)


@register("append_log_append")
def append_log_append(c, rows: DataFrame):
    old = _log(c)
    heads = log.log_report(old).select("log_id", F.col("last_seq").alias("seq"), F.col("head_hash").alias("event_hash"))
    new = written(log.build_chain(rows, heads), "appended")  # the next append reads the log again
    c.append("log", new)
    return new


@register("append_log_verify")
def append_log_verify(c, log_id: str):
    d = _log(c).filter(F.col("log_id") == log_id)
    bad = log.verify_chain(d).agg(F.min(F.struct("seq", "problem")).alias("first"))
    return log.log_report(d).join(bad, F.lit(True)).select("log_id", "events", "last_seq", "head_hash", F.col("first.seq").alias("problem_seq"), F.col("first.problem").alias("problem"))


@register("append_log_mmr_proof")
def append_log_mmr_proof(c, log_id: str, seq: int, domain: str = "karst"):
    leaves = proofs.record_hashes(_log(c).filter(F.col("log_id") == log_id))
    return mmr.proofs(mmr.nodes(leaves, mmr.Domain(domain)), _row(c, "log_id string, leaf_index long", log_id, seq - 1))


@register("append_log_mmr_verify")
def append_log_mmr_verify(c, rows: DataFrame, domain: str = "karst"):
    return mmr.check_proofs(rows, mmr.Domain(domain))


def _found(c: Catalog, kind: str, log_id: str) -> list:
    return [x for x in c.configs.get(kind, []) if x.log_id == log_id]


def _shown(c: Catalog, x, domain: str) -> DataFrame:
    return _row(c, "log_id string, from_seq long, to_seq long, root binary, hash binary, signature binary", x.log_id, x.from_seq, x.to_seq, bytearray(x.root), bytearray(x.record_hash(domain)), bytearray(x.signature))


@register("append_log_checkpoint")
def append_log_checkpoint(c, log_id: str, from_seq: int, to_seq: int, seed: bytes, now_ms: int, domain: str = "karst"):
    before = _found(c, "checkpoints", log_id)
    x = proofs.checkpoint(_log(c), log_id, from_seq, to_seq, seed, now_ms, now_ms, before[-1].record_hash(domain) if before else None, domain)
    c.configs.setdefault("checkpoints", []).append(x)
    return _shown(c, x, domain)


@register("append_log_proof_bundle")
def append_log_proof_bundle(c, log_id: str, domain: str = "karst"):
    records, p = proofs.bundle_parts(_log(c), _found(c, "checkpoints", log_id)[-1], domain)
    return records.join(p, "seq").select("seq", "envelope", "record_hash", "proof")


@register("append_log_proof_verify")
def append_log_proof_verify(c, log_id: str, bundle: DataFrame, domain: str = "karst"):
    x = _found(c, "checkpoints", log_id)[-1]
    return proofs.verify_parts(bundle.select("seq", "envelope", "record_hash"), bundle.select("seq", F.col("record_hash").alias("leaf_hash"), "proof"), x, domain)


@register("append_log_witness")
def append_log_witness(c, log_id: str, seed: bytes, now_ms: int, domain: str = "karst"):
    w = proofs.witness(_found(c, "checkpoints", log_id)[-1], seed, now_ms, domain)
    c.configs.setdefault("witnesses", []).append(w)
    return _shown(c, w, domain)


@register("append_log_witness_request")
def append_log_witness_request(c, log_id: str, domain: str = "karst"):
    """What is sent to others for a countersignature: the checkpoint. Sending is the caller's."""
    return _shown(c, _found(c, "checkpoints", log_id)[-1], domain)


@register("append_log_witness_import")
def append_log_witness_import(c, witness: proofs.Witness, domain: str = "karst"):
    if not any(witness.valid(x, domain) for x in _found(c, "checkpoints", witness.log_id)):
        raise proofs.LogProblem("the witness fits no checkpoint")
    c.configs.setdefault("witnesses", []).append(witness)
    return _shown(c, witness, domain)


@register("append_log_witness_verify")
def append_log_witness_verify(c, log_id: str, domain: str = "karst"):
    rows = [(bytearray(w.identity), any(w.valid(x, domain) for x in _found(c, "checkpoints", log_id))) for w in _found(c, "witnesses", log_id)]
    return c.spark.createDataFrame(rows, "identity binary, valid boolean")


def _tasks(c: Catalog, log_id: str) -> DataFrame:
    return folds.decode_task_events(_log(c).filter(F.col("log_id") == log_id))


def _say(c: Catalog, log_id: str, now_ms: int, payloads: DataFrame) -> DataFrame:
    """Appends JSON payloads (payload) to a log in the order of their text."""
    rows = payloads.select(F.lit(log_id).alias("log_id"), F.lit(now_ms).cast("long").alias("ord"), F.lit(now_ms).cast("long").alias("ingest_ms"), F.col("payload").cast("binary").alias("payload"))
    return append_log_append(c, rows)


@register("append_log_claim")
def append_log_claim(c, log_id: str, task: str, by: str, hlc: int, lease_ms: int, now_ms: int):
    """A request, and the grant that follows where nobody holds the task and the request is the one that wins; gives the state after both."""
    ask = folds.task_payload("claim.request", task=task, hlc=hlc, by=by, lease_ms=lease_ms)
    _say(c, log_id, now_ms, c.spark.range(1).select(ask.alias("payload")))
    g = folds.grants_to_make(_tasks(c, log_id), now_ms).filter((F.col("task") == task) & (F.col("winner") == by))
    asked = _tasks(c, log_id).filter("kind = 'request'").select(F.col("seq").alias("granted_seq"), F.col("hlc").alias("winner_hlc"), F.col("lease_ms").alias("lease"))
    g = g.join(asked, "granted_seq")
    give = folds.task_payload("claim.grant", task=F.col("task"), winner=F.col("winner"), winner_hlc=F.col("winner_hlc"), granted_seq=F.col("granted_seq"), lease_expires_ms=F.lit(now_ms) + F.col("lease"), hlc=hlc)
    _say(c, log_id, now_ms, g.select(give.alias("payload")))
    return append_log_claim_status(c, log_id, task, now_ms)


@register("append_log_claim_status")
def append_log_claim_status(c, log_id: str, task: str, now_ms: int):
    return folds.task_states(_tasks(c, log_id).filter(F.col("task") == task), now_ms)


@register("append_log_claim_release")
def append_log_claim_release(c, log_id: str, task: str, by: str, outcome: str, now_ms: int, hlc: int = 0):
    ask = _row(c, "log_id string, task string, by string, outcome string", log_id, task, by, outcome)
    ok = folds.may_release(append_log_claim_status(c, log_id, task, now_ms), ask)
    _say(c, log_id, now_ms, ok.select(folds.task_payload("claim.release", task=F.col("task"), by=F.col("by"), outcome=F.col("outcome"), hlc=hlc).alias("payload")))
    return append_log_claim_status(c, log_id, task, now_ms)


@register("append_log_claim_supersede")
def append_log_claim_supersede(c, log_id: str, task: str, stale_seq: int, now_ms: int, hlc: int = 0):
    ok = folds.may_supersede(_tasks(c, log_id), _row(c, "log_id string, task string, stale_seq long", log_id, task, stale_seq), now_ms)
    _say(c, log_id, now_ms, ok.select(folds.task_payload("task.superseded", task=F.col("task"), stale_seq=F.col("stale_seq"), hlc=hlc).alias("payload")))
    return append_log_claim_status(c, log_id, task, now_ms)


@register("cluster_presence")
def cluster_presence(c, agents_log: str):
    return folds.agents(_log(c).filter(F.col("log_id") == agents_log))


@register("proof_prefix_root")
def proof_prefix_root(c, prefix: str, first: int = 0, domain: str = "karst"):
    return mmr.prefix_root(c.read("kv"), prefix, first, domain)


# -- trust --------------------------------------------------------------------------------------------------------------


def _trust_add(c: Catalog, rows: DataFrame, domain: str) -> DataFrame:
    checked = proofs.with_signature_check(rows, domain)
    if not checked.filter(~F.col("sig_ok")).isEmpty():
        raise ValueError("bad signature")
    c.append("trust", rows)
    return rows


@register("trust_grant")
def trust_grant(c, rows: DataFrame, domain: str = "karst"):
    return _trust_add(c, rows, domain)


@register("trust_revoke")
def trust_revoke(c, rows: DataFrame, domain: str = "karst"):
    grants = c.read("trust").filter("kind = 'grant'").select(F.col("seq").alias("grant_seq"), "from_org", "to_org")
    if not rows.join(grants, ["grant_seq", "from_org", "to_org"], "left_anti").isEmpty():
        raise ValueError("no such grant")
    return _trust_add(c, rows, domain)


@register("trust_fold")
def trust_fold(c, org: str, at_ms: int, to_org: str | None = None, domain: str = "karst"):
    """The capabilities that hold, each row with ``invalid_events``, the rows of the log that count for nothing; where none holds, a row with that alone."""
    d = written(proofs.with_signature_check(c.read("trust"), domain), "checked")
    bad = folds.invalid_events(d, org, F.col("sig_ok"))
    return bad.join(folds.trust_capabilities(d, org, at_ms, F.col("sig_ok"), to_org), F.lit(True), "left")  # one row on the left


# -- memory -------------------------------------------------------------------------------------------------------------


def _mem(c: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    return c.read("mem_docs", memory.DOCS), c.read("mem_meta", memory.META), c.read("mem_vecs", memory.VECS)


def _config(c: Catalog, ns: str) -> memory.Config:
    x = c.configs.get(f"mem:{ns}")
    if x is None:
        raise memory.MemoryProblem(f"namespace {ns} isn't set up")
    return x


@register("mem_init")
def mem_init(c, ns: str, embedder: str, metric: str = "cosine", tau_hours: float = 168.0, vector_only: bool = False):
    x = c.configs[f"mem:{ns}"] = memory.configured(ns, embedder, metric, tau_hours, vector_only, c.configs.get(f"mem:{ns}"))
    return _row(c, "ns string, embedder string, metric string, tau_hours double, vector_only boolean", x.ns, x.embedder, x.metric, x.tau_hours, x.vector_only)


def _indexed(c: Catalog, ids: DataFrame) -> None:
    """Vectors are indexed and coded as they are added: (ns, id) of each is noted, so health and verification compare what is really there."""
    ids = written(ids.select("ns", "id"), "ids")
    for name in ("mem_index", "mem_codes"):
        c.append(name, ids)


def _forgotten(c: Catalog, ns: str) -> None:
    for name in ("mem_index", "mem_codes"):
        c.put(name, c.read(name, "ns string, id string").filter(F.col("ns") != ns))


@register("mem_add")
def mem_add(c, ns: str, rows: DataFrame, embedder: str | None = None):
    """Documents (id, text, meta, vector, ts_ms); in vector-only namespaces text is not kept. Ids that exist are write-once and refused whole."""
    x = _config(c, ns)
    if embedder is not None and embedder != x.embedder:
        raise memory.MemoryProblem("another embedder")
    docs, meta, vecs = _mem(c)
    d = rows.withColumn("ns", F.lit(ns))
    c.put("mem_vecs", memory.add_bulk(vecs, d.select("ns", "id", "vector", "ts_ms")))
    if not x.vector_only:
        c.put("mem_docs", docs.unionByName(d.select("ns", "id", "text", "ts_ms")))
    c.put("mem_meta", meta.unionByName(d.filter("meta is not null").select("ns", "id", "meta", "ts_ms")))
    _indexed(c, d)
    return d.select("id", memory.added_event(F.col("ns"), F.col("id"), F.col("ts_ms"), F.col("meta")).alias("event"))


@register("mem_bulk_add")
def mem_bulk_add(c, ns: str, rows: DataFrame):
    """Triples (id, vector, meta, ts_ms) without bodies, all or none."""
    _config(c, ns)
    _, meta, vecs = _mem(c)
    d = rows.withColumn("ns", F.lit(ns))
    c.put("mem_vecs", memory.add_bulk(vecs, d.select("ns", "id", "vector", "ts_ms")))
    c.put("mem_meta", meta.unionByName(d.filter("meta is not null").select("ns", "id", "meta", "ts_ms")))
    _indexed(c, d)
    return d.agg(F.count(F.lit(1)).alias("added"))


@register("mem_meta_set")
def mem_meta_set(c, ns: str, ident: str, meta: str, now_ms: int):
    docs, old, vecs = _mem(c)
    new = memory.set_meta(old, docs, vecs, _row(c, memory.META, ns, ident, meta, now_ms))
    c.put("mem_meta", new)
    return new.filter((F.col("ns") == ns) & (F.col("id") == ident))


@register("mem_get")
def mem_get(c, ns: str, ident: str):
    if _config(c, ns).vector_only:
        raise memory.MemoryProblem("a vector-only namespace has no bodies")
    docs, meta, _ = _mem(c)
    return memory.fetch(docs, meta, ns, ident)


@register("mem_query")
def mem_query(c, ns: str, embedding: list[float], k: int = 10, **options):
    x = _config(c, ns)
    docs, meta, vecs = _mem(c)
    return memory.query(vecs, meta, None if x.vector_only else docs, ns, embedding, k, metric=x.metric, **{"tau_hours": x.tau_hours, **options})


@register("mem_range")
def mem_range(c, ns: str, since: int, until: int, limit: int | None = None, where: str | None = None):
    docs, meta, vecs = _mem(c)
    return memory.time_range(vecs if _config(c, ns).vector_only else docs, meta, ns, since, until, limit, where)


@register("mem_stats")
def mem_stats(c, ns: str):
    docs, meta, vecs = _mem(c)
    return memory.stats(vecs, docs, meta, ns)


@register("mem_health")
def mem_health(c, ns: str):
    vecs = _mem(c)[2]
    return memory.health(vecs, c.read("mem_index", "ns string, id string"), ns)


@register("mem_verify")
def mem_verify(c, ns: str):
    docs, _, vecs = _mem(c)
    return memory.verify(vecs, docs, c.read("mem_codes", "ns string, id string"), ns, _config(c, ns).vector_only)


@register("mem_drop")
def mem_drop(c, ns: str):
    docs, meta, vecs = _mem(c)
    out, counts = memory.drop({"mem_docs": docs, "mem_meta": meta, "mem_vecs": vecs}, ns)
    c.tables.update(out)
    kept = out["mem_vecs"].filter(F.col("ns") == ns).select("ns", "id")  # write-once vectors stay indexed
    _forgotten(c, ns)
    _indexed(c, kept)
    c.configs.pop(f"mem:{ns}", None)
    return counts


@register("mem_reset_index")
def mem_reset_index(c, ns: str):
    vecs = _mem(c)[2]
    n = vecs.filter(F.col("ns") == ns).agg(F.count(F.lit(1)).alias("dropped"))
    c.put("mem_vecs", memory.reset_index(vecs, ns))
    _forgotten(c, ns)
    return n


@register("mem_capabilities")
def mem_capabilities(c):
    return _row(c, "capabilities string", memory.capabilities())
