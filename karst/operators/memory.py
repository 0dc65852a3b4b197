"""Document memory (M1-M16, F8-F12): bodies, metadata and vectors of a namespace as tables joined late."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions import vectors as V
from karst.functions.predicate import predicate
from karst.operators.search import clamp_k, top_k

ID = re.compile(r"[A-Za-z0-9\-_./]{1,256}")
NAMESPACE = re.compile(r"[A-Za-z0-9\-_./]{1,64}")
SNIPPET, RANGE_LIMIT, RANGE_MOST, BULK_MOST, SHOWN = 512, 100, 10_000, 10_000, 100
DOCS, META, VECS = "ns string, id string, text string, ts_ms long", "ns string, id string, meta string, ts_ms long", "ns string, id string, vector array<float>, is_worm boolean, ts_ms long"
CAPABILITIES = {"metrics": list(V.METRICS), "filter_operators": ["=", "<", "<=", ">", ">=", "IN"], "max_bulk": BULK_MOST, "max_range": RANGE_MOST, "vector_only": True}


class MemoryProblem(ValueError):
    pass


def check_names(ns: str, ident: str | None = None) -> None:
    if not NAMESPACE.fullmatch(ns):
        raise MemoryProblem(f"not a namespace: {ns!r}")
    if ident is not None and not ID.fullmatch(ident):
        raise MemoryProblem(f"not an id: {ident!r}")


@dataclass(frozen=True)
class Config:
    """Configuration of a namespace; embedder, metric and mode can't change later, the decay time can."""

    ns: str
    embedder: str
    metric: str = "cosine"
    tau_hours: float = 168.0
    vector_only: bool = False

    def updated(self, other: Config) -> Config:
        if replace(self, tau_hours=other.tau_hours) != other:
            raise MemoryProblem("embedder, metric and mode of a namespace are fixed")
        return other


def configured(ns: str, embedder: str, metric: str = "cosine", tau_hours: float = 168.0, vector_only: bool = False, existing: Config | None = None) -> Config:
    """M1: a namespace's configuration, new or equal to ``existing`` but for the decay time."""
    check_names(ns)
    if metric not in V.METRICS:
        raise MemoryProblem(f"unknown metric {metric!r}")
    if not 0 < len(embedder) <= 128 or tau_hours <= 0:
        raise MemoryProblem("embedder of 1 to 128 characters and tau above 0 needed")
    new = Config(ns, embedder, metric, tau_hours, vector_only)
    return existing.updated(new) if existing else new


def latest(df: DataFrame, *columns: str) -> DataFrame:
    """The latest row of each (ns, id)."""
    return df.groupBy("ns", "id").agg(F.max_by(F.struct(*columns, "ts_ms"), "ts_ms").alias("r")).select("ns", "id", *[f"r.{c}" for c in (*columns, "ts_ms")])


def snippet(text: Column, cap: int) -> Column:
    """The first ``cap`` bytes (0: all; below 0: none); a character cut at the end is left out."""
    if cap < 0:
        return F.lit(None).cast("string")
    if cap == 0:
        return text
    b = text.cast("binary")
    cuts = [F.substring(b, 1, max(cap - k, 0)).cast("string") for k in range(4)]  # a character has at most four bytes
    return F.when(F.octet_length(text) <= cap, text).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(x), x) for x in cuts]))


def query(vecs: DataFrame, meta: DataFrame, docs: DataFrame | None, ns: str, embedding: list[float], k: int = 10, decay: float = 0.0, min_score: float | None = None, snippet_bytes: int = SNIPPET, tau_hours: float = 168.0, now_ms: int = 0, where: str | None = None, metric: str = "cosine") -> DataFrame:
    """M6: (id, score, ts_ms, meta, text) of the k nearest documents.

    The metadata filter is applied before the top k, ``min_score`` after it (so fewer than k may remain), and bodies are joined to what is left.
    """
    check_names(ns)
    d = vecs.filter((F.col("ns") == ns) & (F.size("vector") == len(embedding))).select("id", "vector", "ts_ms")
    m = meta.filter(F.col("ns") == ns).select("id", "meta")
    if where is not None:
        d = d.join(m, "id", "left").filter(predicate(where, "meta", "ts_ms"))
    score = V.decayed(V.similarity(V.metric_or_cosine(metric), F.col("vector"), V.vector_literal(embedding)), F.col("ts_ms"), decay, now_ms, tau_hours)
    d = top_k(d.withColumn("score", F.round(score, 6)).select("id", "score", "ts_ms", *(["meta"] if where is not None else [])), clamp_k(k), key="id")
    if min_score is not None:
        d = d.filter(F.col("score") >= min_score)
    if where is None:
        d = F.broadcast(d).join(m, "id", "left")  # at most 100 rows
    if docs is None:
        return d.select("id", "score", "ts_ms", "meta", F.lit(None).cast("string").alias("text")).orderBy(F.desc("score"), "id")
    body = docs.filter(F.col("ns") == ns).select("id", "text")
    return d.join(body, "id", "left").select("id", "score", "ts_ms", "meta", snippet(F.col("text"), snippet_bytes).alias("text")).orderBy(F.desc("score"), "id")


def fetch(docs: DataFrame, meta: DataFrame, ns: str, ident: str | None = None) -> DataFrame:
    """M5: (id, text, meta, ts_ms) of one document or of all; meta is null where there is none."""
    d = docs.filter(F.col("ns") == ns)
    if ident is not None:
        d = d.filter(F.col("id") == ident)
    return d.join(meta.filter(F.col("ns") == ns).select("id", "meta"), "id", "left").select("id", "text", "meta", "ts_ms")


def time_range(docs: DataFrame, meta: DataFrame, ns: str, since: int, until: int, limit: int | None = None, where: str | None = None) -> DataFrame:
    """M8: (id, ts_ms, meta) with since <= ts_ms <= until, by (ts_ms, id), filtered before the limit (None: 100; 0: none)."""
    n = RANGE_LIMIT if limit is None else limit
    if n < 0 or n > RANGE_MOST:
        raise MemoryProblem(f"a limit of 0 to {RANGE_MOST}")
    d = docs.filter((F.col("ns") == ns) & F.col("ts_ms").between(since, until)).select("id", "ts_ms").join(meta.filter(F.col("ns") == ns).select("id", "meta"), "id", "left")
    if where is not None:
        d = d.filter(predicate(where, "meta", "ts_ms"))
    d = d.orderBy("ts_ms", "id")
    return d if n == 0 else d.limit(n)


def validate_bulk(batch: DataFrame, vecs: DataFrame) -> DataFrame:
    """M4: (id, problem) for each problem of a batch (ns, id, vector): bad ids, repeated ids, unequal dimensions, ids that exist. A batch with any is refused whole."""
    ident = batch.filter(F.coalesce(~F.col("id").rlike(f"^{ID.pattern}$"), F.lit(True))).select("id", F.lit("invalid id").alias("problem"))
    twice = batch.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate").alias("problem"))
    there = batch.join(vecs.select("ns", "id").distinct(), ["ns", "id"], "left_semi").select("id", F.lit("exists").alias("problem"))
    size = F.coalesce(F.size("vector"), F.lit(0))
    dims = batch.agg(F.min_by(size, "id").alias("dim"))
    unequal = batch.join(dims, (size != F.col("dim")) | (size <= 0)).select("id", F.lit("dimension").alias("problem"))
    return ident.unionByName(twice).unionByName(there).unionByName(unequal).distinct()


def add_bulk(vecs: DataFrame, batch: DataFrame) -> DataFrame:
    """The vectors with the batch (ns, id, vector, ts_ms), all of it or an error; bulk vectors are write-once."""
    if batch.limit(BULK_MOST + 1).count() > BULK_MOST:
        raise MemoryProblem(f"more than {BULK_MOST} in a batch")
    problem = validate_bulk(batch, vecs).first()
    if problem is not None:
        raise MemoryProblem(f"{problem.id}: {problem.problem}")
    return vecs.unionByName(batch.withColumn("is_worm", F.lit(True)).select(vecs.columns))


def set_meta(meta: DataFrame, docs: DataFrame, vecs: DataFrame, changes: DataFrame) -> DataFrame:
    """M3: metadata with the changes (ns, id, meta, ts_ms) of ids that have a body or, in vector-only namespaces, a vector."""
    known = docs.select("ns", "id").unionByName(vecs.select("ns", "id")).distinct()
    return latest(meta.unionByName(changes.join(known, ["ns", "id"], "left_semi")), "meta")


def orphans(vecs: DataFrame, docs: DataFrame, codes: DataFrame | None, ns: str, vector_only: bool = False) -> DataFrame:
    """(kind, id) of vectors without body, bodies without vector and vectors without code."""
    v, d = (x.filter(F.col("ns") == ns).select("id").distinct() for x in (vecs, docs))
    out = d.join(v, "id", "left_anti").select(F.lit("missing_vector").alias("kind"), "id")
    if not vector_only:
        out = out.unionByName(v.join(d, "id", "left_anti").select(F.lit("missing_body").alias("kind"), "id"))
    if codes is not None:
        c = codes.filter(F.col("ns") == ns).select("id").distinct()
        out = out.unionByName(v.join(c, "id", "left_anti").select(F.lit("missing_code").alias("kind"), "id"))
    return out


def verify(vecs: DataFrame, docs: DataFrame, codes: DataFrame | None, ns: str, vector_only: bool = False) -> DataFrame:
    """(kind, n, ids, truncated): counts with the first 100 ids of each kind."""
    d = orphans(vecs, docs, codes, ns, vector_only)
    from pyspark.sql import Window

    first = d.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter(F.col("rn") <= SHOWN)
    ids = first.groupBy("kind").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(ids, "kind").withColumn("truncated", F.col("n") > SHOWN)


def stats(vecs: DataFrame, docs: DataFrame, meta: DataFrame, ns: str) -> DataFrame:
    """M9: (vectors, bodies, metas, dims), bodies and metadata apart."""
    one = lambda d, n: d.filter(F.col("ns") == ns).agg(F.count(F.lit(1)).alias(n), *([F.max_by(F.size("vector"), "id").alias("dims")] if n == "vectors" else []))
    return one(vecs, "vectors").join(one(docs, "bodies"), F.lit(True)).join(one(meta, "metas"), F.lit(True)).select("vectors", "bodies", "metas", "dims")


def health(vecs: DataFrame, indexed: DataFrame, ns: str) -> DataFrame:
    """(vectors, live, pending, caught_up) of an index's ids against the vectors."""
    v = vecs.filter(F.col("ns") == ns).agg(F.count_distinct("id").alias("vectors"))
    i = indexed.filter(F.col("ns") == ns).agg(F.count_distinct("id").alias("live"))
    pending = F.greatest(F.col("vectors") - F.col("live"), F.lit(0))
    return v.join(i, F.lit(True)).select("vectors", "live", pending.alias("pending"), (pending == 0).alias("caught_up"))


def drop(tables: dict[str, DataFrame], ns: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the namespace, and (name, deleted, skipped); write-once rows stay and are counted."""
    out, counts = {}, None
    for name, d in tables.items():
        worm = F.coalesce(F.col("is_worm"), F.lit(False)) if "is_worm" in d.columns else F.lit(False)
        inside = F.col("ns") == ns
        c = d.filter(inside).agg(F.coalesce(F.sum((~worm).cast("int")), F.lit(0)).alias("deleted"), F.coalesce(F.sum(worm.cast("int")), F.lit(0)).alias("skipped")).select(F.lit(name).alias("name"), "deleted", "skipped")
        counts = c if counts is None else counts.unionByName(c)
        out[name] = d.filter(~inside | worm)
    return out, counts


def reset_index(vecs: DataFrame, ns: str) -> DataFrame:
    """The vectors without those of the namespace; an error, with nothing changed, where one is write-once."""
    if not vecs.filter((F.col("ns") == ns) & F.col("is_worm")).isEmpty():
        raise MemoryProblem("the namespace has write-once vectors")
    return vecs.filter(F.col("ns") != ns)


def capabilities() -> str:
    return json.dumps(CAPABILITIES)


def added_event(ns: Column, ident: Column, ts: Column, meta: Column) -> Column:
    """The event of an added document as JSON, its metadata's top-level fields beside its own."""
    own = F.map_from_arrays(F.array(F.lit("ns"), F.lit("id"), F.lit("ts")), F.array(ns, ident, ts.cast("string")))
    fields = F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(own, F.map_filter(fields, lambda k, _: ~k.isin("ns", "id", "ts"))))


def _fnv1a32(data: bytes, h: int = 0x811C9DC5) -> int:
    for b in data:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


@lru_cache(maxsize=1 << 16)
def _slot(word: str) -> tuple[int, float]:
    """The word's hash and its sign."""
    data = word.encode()
    return _fnv1a32(data), -1.0 if _fnv1a32(data, 0x811C9DC5 ^ 0x9E3779B9) & 1 else 1.0


def hash_embeddings(texts: list[str | None], dim: int = 128) -> np.ndarray:
    """A row for each text: each word [a-z0-9]+ adds +1 or -1 to a bucket, by two FNV-1a hashes; unit length, the first axis where there is no word."""
    words = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    slots = [_slot(w) for one in words for w in one]
    v = np.zeros((len(texts), dim), np.float64)
    if slots:
        h, sign = (np.array(x) for x in zip(*slots))
        np.add.at(v, (np.repeat(np.arange(len(texts)), n), h.astype(np.int64) % dim), sign)
    v[n == 0, 0] = 1.0
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(length > 0, length, 1)).astype(np.float32)


def hash_embedding(text: str | None, dim: int = 128) -> np.ndarray:
    return hash_embeddings([text], dim)[0]


def embedder(dim: int = 128):
    @F.pandas_udf("array<float>")
    def embed(col: pd.Series) -> pd.Series:
        return pd.Series(list(hash_embeddings(col.tolist(), dim)), index=col.index)

    return embed
