"""The most similar vectors of every vector: one graph index per shard, shard results merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.llm.hnsw import Hnsw
from karst.llm.vectors import SHARD_ROWS, current_entries, near, shards, to_matrix, unit
from karst.runtime import written

OUT = "ns string, key string, other string, cos double, first boolean"
SPARE = 8  # candidates beyond k, from which the exact cosine chooses
SLACK = 0.25  # a search ends where the graph's nearest open node is this far below the least wanted cosine


def distinct_vectors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of the first copy of each distinct vector, and for each row the number of its distinct vector."""
    seen: dict[bytes, int] = {}
    of = np.fromiter((seen.setdefault(r.tobytes(), len(seen)) for r in x), np.int64, len(x))
    first = np.full(len(seen), len(x))
    np.minimum.at(first, of, np.arange(len(x)))
    return first, of


def exact(x: np.ndarray, q: np.ndarray, c: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Cosines of the unit rows q, c in float64, rounded to 9 digits."""
    return np.concatenate([np.round(np.einsum("ij,ij->i", x[q[i : i + step]], x[c[i : i + step]]), 9) for i in range(0, len(q), step)] or [np.zeros(0)])


def best_of_all(x: np.ndarray, rows: np.ndarray, others: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``rows``, place in ``others``) of the k rows of ``others`` with the greatest cosine to each of ``rows``, but not itself; of equal ones the first."""
    q, o = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    k = min(k, len(others))
    for i in range(0, len(rows), step):
        c = np.round(x[rows[i : i + step]] @ x[others].T, 9)
        c[rows[i : i + step, None] == others] = -np.inf
        bar = np.partition(c, len(others) - k, axis=1)[:, len(others) - k, None]
        above, equal = c > bar, (c == bar) & (c > -np.inf)
        r, p = np.nonzero(above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))
        q.append(i + r)
        o.append(p)
    return np.concatenate(q), np.concatenate(o)


def shard_neighbours(t: pa.Table, k: int, min_cos: float | None, ef: int) -> pa.Table:
    """The k nearest keys of each query of one shard, ``OUT``.

    Copies of a vector are one node; a node stands for all its keys, of which the k + 1 smallest can be wanted. Where all
    candidates of a node are as near as the k-th, there may be more of the kind (vectors of one direction, say), and the smaller key
    decides: such nodes are compared with all nodes of the shard.
    """
    t = t.sort_by("key")  # so that a row number orders as its key
    x, ok = unit(to_matrix(t["vector"]))
    t, x = t.filter(pa.array(ok)), x[ok]
    home = t["home"].to_numpy()
    raw = np.ascontiguousarray(to_matrix(t["vector"]), np.float32)
    first, of = distinct_vectors(raw)
    none = pa.schema([("ns", pa.string()), ("key", pa.string()), ("other", pa.string()), ("cos", pa.float64()), ("first", pa.bool_())]).empty_table()
    if not home.any():
        return none
    indexed = np.unique(of[home])
    guests = np.setdiff1d(of, indexed)
    x32 = x[first].astype(np.float32)
    index = Hnsw(x32[indexed])
    floor = -2.0 if min_cos is None else min_cos - SLACK
    ids, sim = index.search_self(k + SPARE, ef, floor)
    if len(guests):
        gi, gs = index.search(x32[guests], k + SPARE, ef, floor)
        ids, sim = np.concatenate([ids, gi]), np.concatenate([sim, gs])
    nodes = np.concatenate([indexed, guests])
    kth = min(k, ids.shape[1]) - 1
    tied = np.flatnonzero((ids[:, -1] >= 0) & (sim[:, -1] > floor) & (sim[:, -1] >= sim[:, kth] - 1e-5) & (sim[:, kth] > (floor if min_cos is None else min_cos) - 1e-5))
    usual = np.ones(len(nodes), bool)
    usual[tied] = False
    r, c = np.nonzero((ids >= 0) & (sim > floor) & usual[:, None])
    q, o = nodes[r], indexed[ids[r, c]]
    if len(tied):
        least = np.full(len(first), len(x))
        np.minimum.at(least, of[home], np.flatnonzero(home))
        by_key = indexed[np.argsort(least[indexed])]
        a, b = best_of_all(x, first[nodes[tied]], first[by_key], k + 1)
        q, o = np.concatenate([q, nodes[tied[a]]]), np.concatenate([o, by_key[b]])
    cos = np.concatenate([exact(x, first[q], first[o]), np.ones(len(indexed))])
    q, o = np.concatenate([q, indexed]), np.concatenate([o, indexed])  # a node's own other keys, too
    if min_cos is not None:
        keep = cos >= min_cos
        q, o, cos = q[keep], o[keep], cos[keep]
    # The k + 1 smallest home keys of a node, as a padded table.
    rows = np.flatnonzero(home)
    rows = rows[np.argsort(of[rows], kind="stable")]
    begin = np.flatnonzero(np.r_[True, of[rows][1:] != of[rows][:-1]])
    place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.r_[begin, len(rows)]))
    few = place <= k
    keys_of = np.full((len(first), min(k + 1, int(place.max()) + 1)), -1)
    keys_of[of[rows[few]], place[few]] = rows[few]
    a, b = np.nonzero(keys_of[o] >= 0)
    q, other, cos = q[a], keys_of[o[a], b], cos[a]
    # The best k + 1 keys of each node, then for each of its rows the best k without itself.
    by = np.lexsort((other, -cos, q))
    q, other, cos = q[by], other[by], cos[by]
    begin = np.searchsorted(q, np.arange(len(first)))
    keep = np.arange(len(q)) - begin[q] <= k
    q, other, cos = q[keep], other[keep], cos[keep]
    begin, end = np.searchsorted(q, np.arange(len(first))), np.searchsorted(q, np.arange(len(first)), "right")
    n = (end - begin)[of]
    row = np.repeat(np.arange(len(of)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[of], n)
    other, cos = other[at], cos[at]
    keep = other != row
    row, other, cos = row[keep], other[keep], cos[keep]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    row, other, cos = row[keep], other[keep], cos[keep]
    once = np.zeros(len(row), bool)
    once[np.unique(np.minimum(row, other) * len(of) + np.maximum(row, other), return_index=True)[1]] = True
    keys = t["key"].combine_chunks()
    return pa.table({"ns": t["ns"].combine_chunks().take(pa.array(np.zeros(len(row), int))), "key": keys.take(pa.array(row)), "other": keys.take(pa.array(other)), "cos": cos, "first": once}) if len(row) else none


def _without_copies(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows with at most k + 1 keys of each vector; the rest, and the k + 1 keys that answer for them.

    Copies are counted by hash before anything is shuffled, so a vector that a third of all keys share costs k + 1 rows.
    """
    vid = [F.xxhash64("vector").alias("v1"), F.hash("vector").alias("v2")]
    hot = written(rows.groupBy("ns", *vid).count().filter(F.col("count") > k + 1).select("ns", "v1", "v2", F.lit(True).alias("hot")), "copies")
    count = hot.count()
    if not count:
        return rows, None, None
    d = near(rows.withColumns({"v1": vid[0], "v2": vid[1]}), hot, ["ns", "v1", "v2"], count, "left")
    ranked = d.filter("hot").withColumn("rn", F.row_number().over(Window.partitionBy("ns", "v1", "v2").orderBy("key")))
    kept = ranked.filter(F.col("rn") <= k + 1)  # pruned in each task before the shuffle
    last = written(kept.filter(F.col("rn") == k + 1).select("ns", "v1", "v2", F.col("key").alias("last")), "last")
    rest = near(d.filter("hot"), last, ["ns", "v1", "v2"], count).filter(F.col("key") > F.col("last"))
    cols = rows.columns
    return d.filter("hot is null").select(cols).unionByName(kept.select(cols)), rest.select("ns", "key", "last"), last


def most_similar(rows: DataFrame, k: int = 10, min_cos: float | None = None, ef: int = 40, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(ns, key, other, cos, first): the ``k`` rows of each row's namespace with the greatest cosine to it.

    ``rows`` come from ``current_entries``. Neighbours are found by the shards' graphs (approximately), scored exactly in
    float64, and of equal cosines (9 digits) the smaller key comes first; only those of at least ``min_cos`` where given.
    ``first`` marks one of the two directions of each pair. Vectors that aren't finite or have norm 0 take no part.
    No limit on copies: all keys of one vector get their neighbours.
    """
    rows, rest, last = _without_copies(rows, k)
    parts = shards(rows, shard_rows)
    group = ["ns", "cell", "sub"]
    found = parts.single.groupBy(*group).applyInArrow(lambda t: shard_neighbours(t, k, min_cos, ef), OUT)
    if parts.several is not None:
        merged = parts.several.groupBy(*group).applyInArrow(lambda t: shard_neighbours(t, k, min_cos, ef), OUT).select("ns", "key", "other", "cos").distinct()
        best = Window.partitionBy("ns", "key").orderBy(F.desc("cos"), "other")
        merged = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")
        pair = Window.partitionBy("ns", F.least("key", "other"), F.greatest("key", "other")).orderBy("key")
        found = found.unionByName(merged.withColumn("first", F.row_number().over(pair) == 1))
    if rest is not None:
        # The keys left out have the neighbours of the k + 1st key of their vector, and that one's place: all k before it are as near.
        found = written(found, "neighbours")
        answers = found.join(last.select("ns", F.col("last").alias("key")), ["ns", "key"]).select("ns", F.col("key").alias("last"), "other", "cos")
        found = found.unionByName(rest.join(answers, ["ns", "last"]).select("ns", "key", "other", "cos", F.lit(True).alias("first")))
    return found


def similar_pairs(vectors: DataFrame, k: int = 10, min_cos: float = 0.80, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs of current keys of which one is among the other's ``k`` nearest of at least ``min_cos``.

    A null or empty vector, one of unusual length, not finite or of norm 0 takes no part. Repeated rows and older versions give nothing more;
    an empty table gives an empty result; other columns of ``vectors`` are not looked at.
    """
    found = most_similar(current_entries(vectors), k, min_cos, shard_rows=shard_rows)
    return found.filter("first").select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"))
