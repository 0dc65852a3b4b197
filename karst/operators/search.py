"""Vector search (P1-P7, P11, P12, T1, T4, T5): exact and two-stage, for one query and for many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import vectors as V
from karst.runtime import batches_of, files_of, written

OVERSAMPLE = 20
QUERY_BLOCK, QUERY_FLOATS = 16_384, 16_384 * 128  # most queries, and elements of their vectors, of a task
CORPUS_BLOCK, PIECE = 8_192, 1 << 22  # rows of the corpus that a task reads at a time, scores that it holds


def clamp_k(k: int) -> int:
    """0 means 10; at most 100."""
    return 10 if k == 0 else min(k, 100)


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "key") -> DataFrame:
    """The k rows with the greatest score; of equal scores the smaller key. A partial top-k runs in each task."""
    return df.orderBy(F.desc(score), key).limit(k)


def search(entries: DataFrame, query: list[float], k: int = 10, ns: str = "vec:", metric: str = "cosine", decay: float = 0.0, tau_hours: float = 168.0, now_ms: int = 0, mode: str = "exact", exclude: str | None = None, codes: DataFrame | None = None, params=None) -> DataFrame:
    """(key, score) of the ``k`` entries (key, vector, ts_ms) below ``ns`` most similar to ``query``.

    ``exact`` and ``auto`` score all. ``bq`` and ``bq_rerank`` first take the best 20 k by codes, with decay. Without ``params``
    these are sign codes, and both score what is left exactly. With the ``params`` of ``quantize.fit`` and, where they are stored, the
    ``codes`` (key, code, code_norm, code_corr, ts_ms) of ``quantize.encoded`` they are estimated similarities: ``bq`` gives the estimates,
    ``bq_rerank`` exact scores; for dot products, or a query of another dimension than the codes', both are exact searches. Only the codes are
    read before the choice. Entries of another dimension, null vectors and the key ``exclude`` are passed over. Scores are rounded to 6 digits.
    """
    if tau_hours <= 0:
        raise ValueError("tau_hours must be above 0")
    k, metric = clamp_k(k), V.metric_or_cosine(metric)
    q = V.vector_literal(query)
    d = entries.filter(F.col("key").startswith(ns) & (F.size("vector") == len(query)))
    if exclude is not None:
        d = d.filter(F.col("key") != exclude)
    if mode not in ("exact", "auto", "bq", "bq_rerank"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode.startswith("bq") and params is None:
        coarse = V.hamming_similarity(V.sign_code(F.col("vector")), V.sign_code(q), F.lit(len(query)))
        d = top_k(d.withColumn("score", V.decayed(coarse, F.col("ts_ms"), decay, now_ms, tau_hours)), k * OVERSAMPLE)
    elif mode.startswith("bq") and metric in ("cosine", "l2") and params.metric == metric and len(params.centroid) == len(query):
        from karst.operators import quantize

        c = quantize.encoded(d, params) if codes is None else codes.filter(F.col("key").startswith(ns))
        if exclude is not None:
            c = c.filter(F.col("key") != exclude)
        c = quantize.with_estimate(c.filter("code is not null"), query, params)
        c = top_k(c.select("key", V.decayed(F.col("score"), F.col("ts_ms"), decay, now_ms, tau_hours).alias("score")), k if mode == "bq" else k * OVERSAMPLE)
        if mode == "bq":
            return c.select("key", F.round("score", 6).alias("score"))
        d = d.join(F.broadcast(c.select("key")), "key", "left_semi")  # at most 2,000 keys
    score = V.decayed(V.similarity(metric, F.col("vector"), q), F.col("ts_ms"), decay, now_ms, tau_hours)
    return top_k(d.select("key", F.round(score, 6).alias("score")), k)


def search_by_key(entries: DataFrame, key: str, **options) -> DataFrame:
    """``search`` with the vector of an entry, which is not its own neighbour; empty where the key has none."""
    row = entries.filter((F.col("key") == key) & F.col("vector").isNotNull()).select("vector").first()
    if row is None:
        return entries.sparkSession.createDataFrame([], "key string, score double")
    return search(entries, list(row.vector), exclude=key, **options)


def merge_results(lists: list[DataFrame], k: int, exclude: str | None = None) -> DataFrame:
    """Results of several sources (key, score) as one: the best score of each key, of equal ones that of the earlier source; (key, score, source)."""
    d = None
    for i, x in enumerate(lists):
        x = x.select("key", "score", F.lit(i).alias("source"))
        d = x if d is None else d.unionByName(x)
    if exclude is not None:
        d = d.filter(F.col("key") != exclude)
    best = d.groupBy("key").agg(F.max(F.struct("score", (-F.col("source")).alias("s"))).alias("b"))
    return top_k(best.select("key", F.col("b.score").alias("score"), (-F.col("b.s")).alias("source")), k)


def similarity_of_pair(entries: DataFrame, a: str, b: str, metric: str = "cosine") -> DataFrame:
    """(a, b, score); for l2 the distance itself. Entries of unlike dimension are an error, a missing one gives no row."""
    metric = V.metric_or_cosine(metric)
    x = entries.filter(F.col("key") == a).select(F.col("vector").alias("x"))
    y = entries.filter(F.col("key") == b).select(F.col("vector").alias("y"))
    both = x.join(y, F.lit(True))  # one row each
    score = F.sqrt(V.l2_squared(F.col("x"), F.col("y"))) if metric == "l2" else V.similarity(metric, F.col("x"), F.col("y"))
    checked = F.when(F.size("x") == F.size("y"), F.round(score, 6)).otherwise(F.raise_error(F.lit("dimensions differ")))
    return both.select(F.lit(a).alias("a"), F.lit(b).alias("b"), checked.alias("score"))


def batch_top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """(query, key, score, rank) of the k rows of ``corpus`` (key, vector) nearest to each of ``queries`` (key, vector), scores to 6 digits.

    The corpus is written once to the shared folder. Each task holds a block of queries, reads the corpus from there batch by batch and
    keeps the best k rows of each query so far, so neither side is copied, broadcast or shuffled for the other, and what is found is final.
    Cosines are compared in float32; those that may reach the k-th best, and all other scores, are taken in float64.
    """
    k = clamp_k(k)
    some = lambda d: d.filter("size(vector) > 0").select("key", "vector")
    c = written(some(corpus), "corpus")
    q = c if queries is corpus else some(queries)
    nq, dim = q.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    tasks = q.sparkSession.sparkContext.defaultParallelism
    rows = max(64, min(QUERY_BLOCK, QUERY_FLOATS // (dim or 1)))
    blocks = max(1, -(-nq // rows), min(-(-nq // 128), tasks))  # few queries are cut smaller, so that all cores have some
    blocks = -(-blocks // tasks) * tasks if blocks > tasks else blocks
    files, kind = files_of(c), dict(queries.dtypes)["key"]

    def nearest(batches):
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not len(t):
            return
        keys, vectors = t["key"].combine_chunks(), t["vector"].combine_chunks()
        ask = {n: (rows, v, np.full(len(rows), -np.inf)) for n, rows, v in _by_dim(vectors, metric)}
        best, fresh, waiting = None, [], 0

        def merged():
            d = pa.concat_tables(fresh if best is None else [best, *fresh]).sort_by([("row", "ascending"), ("score", "descending"), ("key", "ascending")])
            row = d["row"].to_numpy()
            place = np.arange(len(d)) - np.searchsorted(row, row)
            d = d.filter(pa.array(place < k))
            last = np.full(len(t), -np.inf)
            full = place == k - 1
            last[row[full]] = d["score"].to_numpy()[place[place < k] == k - 1]
            for rows, _, bar in ask.values():
                bar[:] = last[rows]
            return d

        for b in batches_of(files, ["key", "vector"], CORPUS_BLOCK):
            b = pa.Table.from_batches([b]).sort_by("key")
            names = b["key"].combine_chunks()
            most = pc.max(pc.value_counts(names).field("counts")).as_py() if exclude_self else 0
            asked, named = (pc.fill_null(pc.index_in(x, value_set=names.unique()), -1).to_numpy(zero_copy_only=False) for x in (keys, names))
            for n, at, y in _by_dim(b["vector"].combine_chunks(), metric):
                if n not in ask:
                    continue
                rows, x, bar = ask[n]
                for r, p, score in _candidates(x, y, bar, k, most, metric):
                    if exclude_self:
                        other = asked[rows[r]] != named[at[p]]
                        r, p, score = r[other], p[other], score[other]
                    # Of equal scores the smaller keys (rows are in order of key).
                    by = np.lexsort((p, -score, r))
                    r, p, score = r[by], p[by], score[by]
                    few = np.arange(len(r)) - np.searchsorted(r, r) < k
                    if few.any():
                        fresh.append(pa.table({"row": rows[r[few]].astype(np.int32), "key": names.take(pa.array(at[p[few]])), "score": score[few]}))
                        waiting += int(few.sum())
            if waiting and (best is None or waiting > len(t)):
                best, fresh, waiting = merged(), [], 0
        if fresh:
            best = merged()
        if best is not None and len(best):
            row = best["row"].to_numpy()
            rank = (np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32)
            yield from pa.table({"query": keys.take(pa.array(row)), "key": best["key"], "score": best["score"], "rank": rank}).to_batches(10_000)

    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    return q.repartitionById(blocks, block).mapInArrow(nearest, f"query {kind}, key {kind}, score double, rank int")


def _by_dim(vectors: pa.Array, metric: str):
    """(dimension, row numbers, float64 matrix) of the finite vectors of each dimension, of length 1 for cosines."""
    dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(dims[dims > 0]):
        at = np.flatnonzero(dims == n)
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1).astype(np.float64)
        ok = np.isfinite(x).all(1)
        at, x = at[ok], x[ok]
        if not len(at):
            continue
        if metric == "cosine":
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x /= np.where(norm > 0, norm, 1)
        yield int(n), at, x


def _candidates(x: np.ndarray, y: np.ndarray, bar: np.ndarray, k: int, most: int, metric: str):
    """(rows of x, rows of y, scores to 6 digits) of pairs that may be among the best k of a row of x, by pieces of x; no row of ``bar`` (its k-th best so far) loses one.

    ``most`` rows of y may have the key of a row of x, and don't count.
    """
    kind, slack = (np.float32, 2e-5) if metric == "cosine" else (np.float64, 2e-6)
    xs, ys, nx, ny = x.astype(kind), y.astype(kind).T, (x * x).sum(1), (y * y).sum(1)
    step = max(16, PIECE // max(1, len(y)))
    m = len(y) - k - most
    for i in range(0, len(x), step):
        s = xs[i : i + step] @ ys
        if metric == "l2":
            s = 1 / (1 + np.maximum(nx[i : i + step, None] + ny - 2 * s, 0))
        low = bar[i : i + step].copy()
        new = np.flatnonzero(low == -np.inf)
        if len(new) and m >= 0:
            low[new] = np.partition(s[new], m, axis=1)[:, m]
        low -= slack + 1e-12 * np.abs(np.where(np.isfinite(low), low, 0))
        hit = np.flatnonzero(s.max(1) >= low)
        if not len(hit):
            continue
        r, p = np.nonzero(s[hit] >= low[hit, None].astype(kind))
        r = hit[r] + i
        score = np.empty(len(r))
        for j in range(0, len(r), 1 << 16):
            a, b = r[j : j + (1 << 16)], p[j : j + (1 << 16)]
            score[j : j + (1 << 16)] = np.einsum("ij,ij->i", x[a], y[b]) if metric != "l2" else 1 / (1 + np.square(x[a] - y[b]).sum(1))
        yield r, p, np.round(score, 6)


def vector_stats(entries: DataFrame, ns: str = "vec:", codes: DataFrame | None = None, inserts: int | None = None) -> DataFrame:
    """(vectors, dims, worm): the dimension is that of the greatest key. With ``codes`` also ``codes`` and ``inserts``, which is as many as there are vectors where it isn't known."""
    d = entries.filter(F.col("key").startswith(ns))
    if codes is not None:
        n = codes.filter(F.col("key").startswith(ns) & F.col("code").isNotNull()).agg(F.count_distinct("key").alias("codes"))
        return vector_stats(entries, ns).join(n, F.lit(True)).withColumn("inserts", F.col("vectors") if inserts is None else F.lit(inserts).cast("long"))  # one row each
    return d.agg(F.count(F.lit(1)).alias("vectors"), F.max_by(F.size("vector"), "key").alias("dims"), F.coalesce(F.sum(F.col("is_worm").cast("int")), F.lit(0)).alias("worm"))


def reindex_report(entries: DataFrame, ns: str = "vec:") -> DataFrame:
    """(dim, inserted, skipped): what an index of the first entry's dimension takes in and leaves out."""
    d = entries.filter(F.col("key").startswith(ns)).select("key", F.coalesce(F.size("vector"), F.lit(0)).alias("n"))
    dim = d.filter("n > 0").agg(F.min_by("n", "key").alias("dim"))
    return d.join(dim, F.lit(True)).groupBy("dim").agg(F.sum((F.col("n") == F.col("dim")).cast("int")).alias("inserted"), F.sum((F.col("n") != F.col("dim")).cast("int")).alias("skipped"))


def namespace_metrics(entries: DataFrame) -> DataFrame:
    """(ns, metric, metrics) of each namespace of (key, metric): its smallest metric and how many it has; more than one is a conflict. Null metrics count as none."""
    d = entries.filter("key is not null").select(F.regexp_extract("key", r"(?s)^(.*:)", 1).alias("ns"), F.lower(F.trim("metric")).alias("metric"))
    return d.groupBy("ns").agg(F.min("metric").alias("metric"), F.count_distinct("metric").alias("metrics"))


def insert_batch(entries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) of a batch (key, vector, ...): an unusable length or a write-once key is rejected."""
    ns = F.regexp_extract("key", r"(?s)^(.*:)", 1)
    dims = entries.filter(F.size("vector") > 0).groupBy(ns.alias("ns")).agg(F.min_by(F.size("vector"), "key").alias("ns_dim"))
    worm = entries.filter("is_worm").select("key", F.lit(True).alias("frozen")).distinct()
    d = rows.withColumn("ns", ns).join(dims, "ns", "left").join(worm, "key", "left")
    n = F.coalesce(F.size("vector"), F.lit(0))
    reason = F.when(n <= 0, "empty").when(F.col("frozen"), "worm").when(n != F.coalesce("ns_dim", n), "dimension")
    d = d.withColumn("reason", reason)
    return d.filter("reason is null").select(rows.columns), d.filter("reason is not null").select(*rows.columns, "reason")


def delete_keys(entries: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what remains, a row (key, outcome) for each key): deleted, worm or missing."""
    hit = keys.select("key").distinct().join(entries.groupBy("key").agg(F.max("is_worm").alias("worm")).withColumn("there", F.lit(True)), "key", "left")
    outcome = F.when(F.col("there").isNull(), "missing").when(F.col("worm"), "worm").otherwise("deleted")
    out = hit.select("key", outcome.alias("outcome"))
    return entries.join(out.filter("outcome = 'deleted'"), "key", "left_anti"), out


def drop_namespace(entries: DataFrame, ns: str) -> tuple[DataFrame, DataFrame]:
    """(what remains, (deleted, skipped)): write-once entries stay."""
    inside = F.col("key").startswith(ns)
    worm = F.coalesce(F.col("is_worm"), F.lit(False))
    counts = entries.filter(inside).agg(F.coalesce(F.sum((~worm).cast("int")), F.lit(0)).alias("deleted"), F.coalesce(F.sum(worm.cast("int")), F.lit(0)).alias("skipped"))
    return entries.filter(~inside | worm), counts
