"""Clusters of mutually similar vectors by parallel pivots, their sizes and most typical members.

Keys are ordered by hash. In each round a key whose hash is the smallest among its similar open neighbours becomes a
pivot, and the open neighbours of pivots are absorbed; rounds go on until no key is open. So the pivots are those of the
greedy order by hash, whatever the shards: inside a shard rounds are matrix products over blocks of that order, for namespaces of several
shards they are such products of pairs of blocks that tasks read from the shared folder. Members are then given to the closest pivot, and medoids are taken from the result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.llm.neighbours import distinct_vectors, exact
from karst.llm.vectors import SHARD_ROWS, current_entries, near, shards, to_matrix, unit
from karst.runtime import batches_of, drop_read, files_of, written

BLOCK = 2048
NEAR = 1e-5  # more than the error of a float32 cosine: closer to a limit, float64 decides
OUT = "ns string, key string, pivot string, score double, tight boolean"


def similar(x: np.ndarray, x32: np.ndarray, rows: np.ndarray, others: np.ndarray, at: float) -> np.ndarray:
    """Which of ``rows`` (first axis) and ``others`` have a cosine of at least ``at``, to 9 digits."""
    s = x32[rows] @ x32[others].T
    out = s >= at
    r, c = np.nonzero(np.abs(s - at) < NEAR)
    out[r, c] = exact(x, rows[r], others[c]) >= at
    return out


def pivots_of(x: np.ndarray, x32: np.ndarray, rank: np.ndarray, at: float) -> np.ndarray:
    """The pivots of the unit rows: blocks in order of rank drop what a pivot so far has absorbed, and have rounds among the rest."""
    order = np.argsort(rank)
    pivots = np.empty(0, np.int64)
    for i in range(0, len(order), BLOCK):
        open_ = order[i : i + BLOCK]
        for j in range(0, len(pivots), 4 * BLOCK):
            if len(open_):
                open_ = open_[~similar(x, x32, open_, pivots[j : j + 4 * BLOCK], at).any(1)]
        if not len(open_):
            continue
        near = np.tril(similar(x, x32, open_, open_, at), -1)  # columns are the earlier ones
        chosen, left = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        while left.any():
            new = left & ~near[:, left].any(1)
            chosen |= new
            left &= ~new & ~near[:, new].any(1)
        pivots = np.concatenate([pivots, open_[chosen]])
    return pivots


def closest(x: np.ndarray, x32: np.ndarray, rows: np.ndarray, heads: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The head with the greatest cosine to each of ``rows``, of equal ones (9 digits) that of the smallest rank, and the cosine."""
    head, cos = np.empty(len(rows), np.int64), np.empty(len(rows))
    step = max(16, (1 << 23) // len(heads))
    for i in range(0, len(rows), step):
        some = rows[i : i + step]
        s = x32[some] @ x32[heads].T
        r, c = np.nonzero(s >= s.max(1, keepdims=True) - 1e-5)  # within the error of float32
        e = exact(x, some[r], heads[c])
        by = np.lexsort((rank[heads[c]], -e, r))
        first = by[np.r_[True, r[by][1:] != r[by][:-1]]]
        head[i : i + step], cos[i : i + step] = heads[c[first]], e[first]
    return head, cos


def pivot_clusters(x: np.ndarray, rank: np.ndarray, at: float) -> np.ndarray:
    """The closest pivot of each unit row (a pivot is its own)."""
    x32 = x.astype(np.float32)
    heads = pivots_of(x, x32, rank, at)
    root = np.full(len(x), -1)
    root[heads] = heads
    rest = np.flatnonzero(root < 0)
    if len(rest):
        root[rest] = closest(x, x32, rest, heads, rank)[0]
    return root


def far_pair(a: np.ndarray, b: np.ndarray, at: float) -> bool:
    """Whether any row of a and row of b have a cosine below ``at``."""
    return any((np.round(a[i : i + BLOCK] @ b[j : j + BLOCK].T, 9) < at).any() for i in range(0, len(a), BLOCK) for j in range(0, len(b), BLOCK))


def near_rows(a: np.ndarray, b: np.ndarray, at: float) -> np.ndarray:
    """Which rows of b have a cosine of at least ``at`` to any row of a."""
    out = np.zeros(len(b), bool)
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            out[j : j + BLOCK] |= (np.round(a[i : i + BLOCK] @ b[j : j + BLOCK].T, 9) >= at).any(0)
    return out


def angles_to_mean(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the unit rows: mean cosine to all of them, and angle to their mean."""
    m = x.mean(0)
    s = x @ m
    n = np.linalg.norm(m)
    return s, np.arccos(np.clip(s / n, -1, 1)) if n > 0 else np.full(len(x), np.pi)


def all_similar(x: np.ndarray, at: float) -> bool:
    """Whether all pairs are similar. Two rows whose angles to the mean add up to no more than the limit are, so only the others are compared."""
    _, angle = angles_to_mean(x)
    limit = np.arccos(at) - 1e-6
    far = angle > limit / 2
    return not far.any() or not far_pair(x[far], x[angle > limit - angle.max()], at)


def shard_clusters(t: pa.Table, at: float) -> pa.Table:
    """Clusters of the home rows of one shard: key, pivot, mean cosine to the cluster, and whether the cluster is tight:
    all its rows similar to each other and none to a row outside. Copies of a vector are one node, and always together."""
    t = t.filter(t["home"])
    x, ok = unit(to_matrix(t["vector"]))
    t, x = t.filter(pa.array(ok)), x[ok]
    if not len(t):
        return pa.table({"ns": pa.array([], pa.string()), "key": pa.array([], pa.string()), "pivot": pa.array([], pa.string()), "score": pa.array([], pa.float64()), "tight": pa.array([], pa.bool_())})
    first, of = distinct_vectors(np.ascontiguousarray(to_matrix(t["vector"]), np.float32))
    order = np.empty(len(t), np.int64)
    order[np.lexsort((t["key"].to_numpy(zero_copy_only=False).astype(str), t["h"].to_numpy()))] = np.arange(len(t))
    rank = np.full(len(first), len(t))
    np.minimum.at(rank, of, order)
    head = np.empty(len(first), np.int64)  # the row of each node with the smallest hash
    head[of[np.argsort(-order)]] = np.argsort(-order)
    root = pivot_clusters(x[first], rank, at)
    cluster = root[of]
    by = np.argsort(cluster, kind="stable")
    begin = np.flatnonzero(np.r_[True, cluster[by][1:] != cluster[by][:-1]])
    groups = np.split(by, begin[1:])
    score, tight = np.ones(len(t)), np.ones(len(t), bool)
    loose = np.zeros(len(first), bool)
    radius, centre = np.zeros(len(groups)), np.empty((len(groups), x.shape[1]))
    for k, g in enumerate(groups):
        if len(g) > 1:
            score[g], angle = angles_to_mean(x[g])
            if not all_similar(x[g], at):
                loose[cluster[g[0]]] = True
            radius[k] = angle.max()
        centre[k] = x[g].mean(0)
    # Clusters that may reach each other, by their means and radii.
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    number = np.empty(len(t), np.int64)
    number[by] = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    centre32 = centre.astype(np.float32)
    open_ = [k for k, g in enumerate(groups) if len(g) > 2 and not loose[cluster[g[0]]]]
    step = max(1, (1 << 23) // len(groups))
    for i in range(0, len(open_), step):
        some = open_[i : i + step]
        reach = np.arccos(np.clip(centre[some].astype(np.float32) @ centre32.T, -1, 1)) <= np.arccos(at) + radius[some, None] + radius[None] + 2e-3
        for k, near in zip(some, reach):
            near[k] = False
            rows = np.flatnonzero(near[number]) if near.any() else []
            if len(rows):
                rows = rows[near_rows(x[groups[k]], x[rows], at)]
            if len(rows):
                loose[cluster[rows]] = loose[cluster[groups[k][0]]] = True
    tight = ~loose[cluster]
    keys = t["key"].combine_chunks()
    return pa.table({"ns": t["ns"], "key": keys, "pivot": keys.take(pa.array(head[cluster])), "score": score, "tight": tight})


def _load(files: list[str], columns: list[str]) -> pa.Table:
    return pa.Table.from_batches(list(batches_of(files, columns, 1 << 16)))


def _by_block(d: DataFrame) -> dict[int, list[str]]:
    """The files of each block of a table that is written by block."""
    found: dict[int, list[str]] = {}
    for f in files_of(d):
        found.setdefault(int(re.search(r"/block=(\d+)/", f)[1]), []).append(f)
    return found


def _nodes(several: DataFrame) -> DataFrame | None:
    """(block, ns, pivot, keys, vector) of the usable home rows, written by block (``ns, cell, sub``), in order of ``pivot``: the key with its hash before it.

    Copies of a vector are one node, that of the smallest pivot, with all their ``keys``; they always share a block.
    """
    home = several.filter("home").select("ns", "cell", "sub", "key", "h", "vector")
    cells = [(r.ns, r.cell, r["sub"], i) for i, r in enumerate(home.select("ns", "cell", "sub").distinct().orderBy("ns", "cell", "sub").collect())]  # about two per shard_rows
    if not cells:
        return None
    number = home.sparkSession.createDataFrame(cells, "ns string, cell int, sub int, block int")
    rows = near(home, number, ["ns", "cell", "sub"], len(cells)).select("block", "ns", F.concat(F.lpad(F.hex("h"), 16, "0"), "key").alias("pivot"), "vector")

    def collapse(batches):
        found: dict[bytes, list[str]] = {}
        block = ns = None
        for b in batches:
            x = np.ascontiguousarray(to_matrix(b["vector"]), np.float32) + np.float32(0)  # no negative zeros
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            block, ns = (b["block"][0], b["ns"][0]) if len(x) else (block, ns)
            for v, name, good in zip(x, b["pivot"].to_pylist(), ok):
                if good:
                    found.setdefault(v.tobytes(), []).append(name)
        nodes = sorted((sorted(names), v) for v, names in found.items())
        for i in range(0, len(nodes), BLOCK):
            some = nodes[i : i + BLOCK]
            x = np.frombuffer(b"".join(v for _, v in some), np.float32).reshape(len(some), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.as_py()] * len(some), pa.int32()), pa.array([ns.as_py()] * len(some)), pa.array([n[0] for n, _ in some]), pa.array([[k[16:] for k in n] for n, _ in some], pa.list_(pa.string())), pa.array(list(x), pa.list_(pa.float32()))],
                ["block", "ns", "pivot", "keys", "vector"],
            )

    return written(rows.repartitionById(len(cells), F.col("block")).mapInArrow(collapse, "block int, ns string, pivot string, keys array<string>, vector array<float>"), "nodes", "block")


def _pairs(files: dict[int, list[str]], nodes: DataFrame, at: float) -> list[tuple[int, int]]:
    """The pairs of blocks of a namespace (i <= j) that may have similar rows: their centres are no further apart than the limit and both radii together."""

    def shape(batches):
        for b in batches:
            for i in b["block"].to_pylist():
                t = _load(files[i], ["ns", "vector"])
                x = unit(to_matrix(t["vector"]))[0]
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "ns": t["ns"][:1].combine_chunks(), "centre": pa.array([x.mean(0)], pa.list_(pa.float64())), "radius": [float(angles_to_mean(x)[1].max())]})

    by: dict[str, list] = {}
    for r in _blocks(nodes, files).mapInArrow(shape, "block int, ns string, centre array<double>, radius double").collect():
        by.setdefault(r.ns, []).append((r.block, np.array(r.centre), r.radius))
    out = []
    for v in by.values():
        block, c, radius = np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        near_ = np.arccos(np.clip(c @ c.T, -1, 1)) <= np.arccos(at) + radius[:, None] + radius + 1e-6
        near_ |= (radius[:, None] >= np.pi) | (radius >= np.pi)
        out += [(int(block[i]), int(block[j])) for i, j in zip(*np.nonzero(near_)) if block[i] <= block[j]]
    return sorted(out)


def _blocks(nodes: DataFrame, files: dict[int, list[str]]) -> DataFrame:
    """(block): a row for each block, spread over tasks that read them."""
    return nodes.sparkSession.createDataFrame([(i,) for i in sorted(files)], "block int").repartition(len(files), "block")


def _near(x: np.ndarray, x32: np.ndarray, rows: np.ndarray, others: np.ndarray, at: float):
    """(some of ``rows``, which of ``others`` they are similar to) of those that are similar to any, piece by piece."""
    step = max(16, (1 << 22) // max(1, len(others)))
    y = x32[others].T
    for i in range(0, len(rows), step):
        some = rows[i : i + step]
        hit = some[(x32[some] @ y).max(1) >= at - NEAR]
        if len(hit):
            yield hit, similar(x, x32, hit, others, at)


def _two(files: dict[int, list[str]], i: int, j: int, a: np.ndarray | None, b: np.ndarray | None):
    """Unit rows of block i and, where it is another, block j (those numbered in a and b, or all), names, and which of them are on each side."""

    def rows(k, at):
        t = _load(files[k], ["pivot", "vector"])
        return t if at is None else t.take(pa.array(at))

    t = rows(i, a)
    n = len(t)
    if i != j:
        t = pa.concat_tables([t, rows(j, b)])
    x = unit(to_matrix(t["vector"]))[0]
    left = np.arange(n)
    return x, x.astype(np.float32), t["pivot"].to_numpy(), left, left if i == j else np.arange(n, len(t))


def _bits(on: np.ndarray) -> bytes:
    return np.packbits(on).tobytes()


def _numbers(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))


def _edges(nodes: DataFrame, files: dict[int, list[str]], at: float) -> DataFrame:
    """(i, j, a, b): pairs of blocks with similar rows, and bits of the rows of each that are similar to any other of the other. All later steps look only at these."""
    pairs = _pairs(files, nodes, at)

    def find(batches):
        for rows in batches:
            for i, j in zip(rows["i"].to_pylist(), rows["j"].to_pylist()):
                x, x32, _, left, right = _two(files, i, j, None, None)
                on = np.zeros(len(x), bool)
                for some, like in _near(x, x32, left, right, at):
                    if i == j:
                        like[np.arange(len(some)), some] = False  # itself
                    on[some] |= like.any(1)
                    on[right] |= like.any(0)
                if on.any():
                    yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "a": [_bits(on[left])], "b": [_bits(on[right])]})

    d = nodes.sparkSession.createDataFrame(pairs, "i int, j int").repartition(_tasks(nodes, len(pairs)))
    return written(d.mapInArrow(find, "i int, j int, a binary, b binary"), "edges")


def _tasks(d: DataFrame, pairs: int) -> int:
    return max(1, min(pairs, max(8 * d.sparkSession.sparkContext.defaultParallelism, pairs // 8)))


def _meetings(batches, files: dict[int, list[str]], from_: dict[int, np.ndarray], to: dict[int, np.ndarray]):
    """Each way round for each of the edges: block, numbers of its rows in ``from_``, the other block, numbers of its rows in ``to``, unit rows, ranks of their names, names, places of the first and of the second among them."""
    for rows in batches:
        for i, j, a, b in zip(*(rows[c].to_pylist() for c in ("i", "j", "a", "b"))):
            a, b = _numbers(a), _numbers(b)
            a, b = a[from_[i][a] | to[i][a]], b[from_[j][b] | to[j][b]]
            ways = [(i, a, j, b)] if i == j else [(i, a, j, b), (j, b, i, a)]
            if not any(from_[p][k].any() and to[q][m].any() for p, k, q, m in ways):
                continue
            x, x32, name, l, r = _two(files, i, j, a, b)
            rank = np.empty(len(x), np.int64)
            rank[np.argsort(name, kind="stable")] = np.arange(len(x))
            for (p, k, q, m), (l, r) in zip(ways, ((l, r), (r, l))):
                mine, other = from_[p][k], to[q][m]
                if mine.any() and other.any():
                    yield p, k[mine], q, m[other], x, x32, rank, name, l[mine], r[other]


def _sent(d: DataFrame, *bits: dict[int, np.ndarray]):
    return d.sparkSession.sparkContext.broadcast([{k: _bits(v) for k, v in some.items()} for some in bits])


def _opened(sent) -> list[dict[int, np.ndarray]]:
    return [{k: np.unpackbits(np.frombuffer(v, np.uint8)).astype(bool) for k, v in some.items()} for some in sent.value]


def _marked(edges: DataFrame, files: dict[int, list[str]], at: float, left: dict[int, np.ndarray], right: dict[int, np.ndarray], smaller: bool) -> dict[int, np.ndarray]:
    """By block, which rows of ``left`` are similar to another of ``right``, where ``smaller`` to one with a smaller name. Bits by block are all that reaches the driver."""
    sent = _sent(edges, left, right)

    def mark(batches):
        from_, to = _opened(sent)
        found: dict[int, np.ndarray] = {}
        for block, own, _, _, x, x32, rank, _, l, r in _meetings(batches, files, from_, to):
            on = np.zeros(len(x), bool)
            for some, like in _near(x, x32, l, r, at):
                like &= rank[r] < rank[some][:, None] if smaller else r != some[:, None]
                on[some] |= like.any(1)
            found.setdefault(block, np.zeros(len(from_[block]), bool))[own[on[l]]] = True
        for block, on in found.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "on": [_bits(on)]})

    def either(t: pa.Table) -> pa.Table:
        return pa.table({"block": t["block"][:1], "on": [np.bitwise_or.reduce([np.frombuffer(v, np.uint8) for v in t["on"].to_pylist()]).tobytes()]})

    out = {k: np.zeros(len(v), bool) for k, v in left.items()}
    for r in edges.mapInArrow(mark, "block int, on binary").groupBy("block").applyInArrow(either, "block int, on binary").collect():
        out[r.block] = np.unpackbits(np.frombuffer(r.on, np.uint8)).astype(bool)[: len(out[r.block])]
    return out


def _closest(edges: DataFrame, files: dict[int, list[str]], at: float, rows: dict[int, np.ndarray], heads: dict[int, np.ndarray]) -> DataFrame:
    """(block, row, to): the name of the one of ``heads`` with the greatest cosine to each of ``rows``, of equal ones (9 digits) the smallest."""
    sent = _sent(edges, rows, heads)

    def best(batches):
        for block, own, _, _, x, x32, rank, name, l, r in _meetings(batches, files, *_opened(sent)):
            number = np.empty(len(x), np.int32)
            number[l] = own
            for some, like in _near(x, x32, l, r, at):
                n, c = np.nonzero(like)
                cos = exact(x, some[n], r[c])
                by = np.lexsort((rank[r[c]], -cos, n))
                first = by[np.flatnonzero(np.r_[True, n[by][1:] != n[by][:-1]])] if len(by) else by
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(first), pa.int32()), "row": number[some[n[first]]], "c": -cos[first], "to": pa.array(name[r[c[first]]], pa.string())})

    d = edges.mapInArrow(best, "block int, row int, c double, to string")
    return d.groupBy("block", "row").agg(F.min(F.struct("c", "to")).alias("m")).select("block", "row", F.col("m.to").alias("to"))


def _loose(edges: DataFrame, files: dict[int, list[str]], of: DataFrame, at: float) -> DataFrame:
    """(ns, to) of the clusters with two rows that aren't similar, or a row similar to one of another cluster."""
    named = _by_block(of)
    all_ = {r.block: np.ones(r.n, bool) for r in of.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = _sent(edges, all_)

    def count(batches):
        every = _opened(sent)[0]
        for block, own, other, met, x, x32, _, _, l, r in _meetings(batches, files, every, every):
            mine, theirs = (_load(named[k], ["row", "to", "copies"]).sort_by("row").take(pa.array(n)) for k, n in ((block, own), (other, met)))
            cluster = np.unique(np.concatenate([mine["to"].to_numpy(), theirs["to"].to_numpy()]).astype(str), return_inverse=True)[1]
            a, b = cluster[: len(own)], cluster[len(own) :]
            copies, at_ = theirs["copies"].to_numpy(), np.empty(len(x), np.int64)
            at_[l] = np.arange(len(l))
            for some, like in _near(x, x32, l, r, at):
                like &= r != some[:, None]
                same = like & (a[at_[some]][:, None] == b)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(some), pa.int32()), "row": own[at_[some]].astype(np.int32), "inside": same @ copies, "outside": (like & ~same).any(1)})

    met = edges.mapInArrow(count, "block int, row int, inside long, outside boolean").groupBy("block", "row").agg(F.sum("inside").alias("inside"), F.max("outside").alias("outside"))
    d = of.join(met, ["block", "row"], "left")
    return d.filter(F.coalesce("outside", F.lit(False)) | (F.col("copies") + F.coalesce("inside", F.lit(0)) != F.col("size"))).select("ns", "to").distinct()


def _scored(nodes: DataFrame, files: dict[int, list[str]], of: DataFrame) -> DataFrame:
    """(ns, key, to, score) of all keys. Clusters are added up in each block; only the sums of those that lie in several blocks are shuffled."""
    named = _by_block(of)

    def rows(i):
        t, o = _load(files[i], ["keys", "vector"]), _load(named[i], ["row", "ns", "to", "copies", "nodes", "size"]).sort_by("row")
        name, cluster, here = np.unique(o["to"].to_numpy().astype(str), return_inverse=True, return_counts=True)
        x = unit(to_matrix(t["vector"]))[0]
        total = np.zeros((len(name), x.shape[1]))
        np.add.at(total, cluster, x * o["copies"].to_numpy()[:, None])
        nodes_ = np.zeros(len(name), np.int64)
        nodes_[cluster] = o["nodes"].to_numpy()
        return t, o, name, cluster, x, total, nodes_ > here

    def add(batches):
        for b in batches:
            for i in b["block"].to_pylist():
                _, _, name, _, _, total, part = rows(i)
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i] * int(part.sum()), pa.int32()), "to": pa.array(name[part].tolist()), "sum": pa.array(list(total[part]), pa.list_(pa.float64()))})

    def whole(t: pa.Table) -> pa.Table:
        s = to_matrix(t["sum"]).sum(0)
        return pa.table({"block": t["block"], "to": t["to"], "sum": pa.array([s] * len(t), pa.list_(pa.float64()))})

    schema = "block int, to string, sum array<double>"
    blocks = _blocks(nodes, files)
    sums = _by_block(written(blocks.mapInArrow(add, schema).groupBy("to").applyInArrow(whole, schema).repartition(F.col("block")), "sums", "block"))

    def score(batches):
        for b in batches:
            for i in b["block"].to_pylist():
                t, o, name, cluster, x, total, part = rows(i)
                if i in sums:
                    s = _load(sums[i], ["to", "sum"])
                    total[np.searchsorted(name, s["to"].to_numpy().astype(str))] = to_matrix(s["sum"])
                mean = np.where(o["nodes"].to_numpy() > 1, np.einsum("ij,ij->i", x, total[cluster]) / o["size"].to_numpy(), 1.0)
                keys = t["keys"].combine_chunks()
                each = keys.value_lengths().to_numpy()
                at = pa.array(np.repeat(np.arange(len(t)), each))
                yield from pa.table({"ns": o["ns"].take(at), "key": keys.flatten(), "to": o["to"].take(at), "score": mean[at]}).to_batches(10_000)

    return blocks.mapInArrow(score, "ns string, key string, to string, score double")


def _across(several: DataFrame, at: float) -> DataFrame:
    """Clusters of namespaces of several shards.

    Vectors are written by block once. Tasks read the blocks that they compare, so nothing is copied for the pairs of blocks: these are compared once, all that
    may have similar rows, and bits of the rows that have any are kept. Rounds, closest pivots and the check of the clusters look at those rows only.
    """
    nodes = _nodes(several)
    spark = several.sparkSession
    files = _by_block(nodes) if nodes is not None else {}
    if not files:
        return spark.createDataFrame([], OUT)
    drop_read(several)
    edges = _edges(nodes, files, at)
    edges = edges.repartition(_tasks(edges, edges.count()))
    open_ = {r.block: np.ones(r.n, bool) for r in nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    heads = {k: np.zeros(len(v), bool) for k, v in open_.items()}
    while any(v.any() for v in open_.values()):
        later = _marked(edges, files, at, open_, open_, True)
        new = {k: v & ~later[k] for k, v in open_.items()}
        gone = _marked(edges, files, at, later, new, False)
        open_ = {k: v & ~gone[k] for k, v in later.items()}
        heads = {k: v | new[k] for k, v in heads.items()}

    def listed(batches):
        for b in batches:
            for i in b["block"].to_pylist():
                t = _load(files[i], ["ns", "pivot", "keys"])
                yield from pa.table({"block": pa.array([i] * len(t), pa.int32()), "row": np.arange(len(t), dtype=np.int32), "ns": t["ns"], "pivot": t["pivot"], "copies": t["keys"].combine_chunks().value_lengths().cast(pa.int64())}).to_batches(10_000)

    d = _blocks(nodes, files).mapInArrow(listed, "block int, row int, ns string, pivot string, copies long")
    d = d.join(_closest(edges, files, at, {k: ~v for k, v in heads.items()}, heads), ["block", "row"], "left")
    d = written(d.select("block", "row", "ns", F.coalesce("to", "pivot").alias("to"), "copies"), "closest")
    size = d.groupBy("ns", "to").agg(F.count(F.lit(1)).alias("nodes"), F.sum("copies").alias("size"))
    of = written(d.join(size, ["ns", "to"]).repartition(F.col("block")), "members", "block")
    loose = written(_loose(edges, files, of, at), "loose").withColumn("loose", F.lit(True))
    d = _scored(nodes, files, of).join(loose, ["ns", "to"], "left")
    return d.select("ns", "key", F.expr("substring(to, 17)").alias("pivot"), "score", F.col("loose").isNull().alias("tight"))


def clusters(rows: DataFrame, at: float = 0.80, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(ns, key, pivot, score, tight) of every usable row of ``rows`` (from ``current_entries``); ``score`` is the mean cosine to the cluster.

    ``tight`` clusters are those whose rows are all similar to each other and to no row outside.
    """
    parts = shards(rows, shard_rows)
    found = parts.single.groupBy("ns", "cell", "sub").applyInArrow(lambda t: shard_clusters(t, at), OUT)
    if parts.several is None:
        return found
    return found.unionByName(_across(parts.several, at))


def live_entries(ops: DataFrame) -> DataFrame:
    """The current usable vector of each key of an operation log; the namespace is taken from the key.

    Deleted keys, null keys and unusable vectors have none; a null operation counts as an insert.
    """
    return current_entries(ops, keep=F.coalesce(F.lower(F.trim("op")) != "delete", F.lit(True)))


def tight_clusters(ops: DataFrame, at: float = 0.80, least: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(cluster_key, key): members of tight clusters of at least ``least`` keys; ``cluster_key`` is the smallest of them."""
    d = written(clusters(live_entries(ops), at, shard_rows).filter("tight").select("ns", "key", "pivot"), "tight")
    names = d.groupBy("ns", "pivot").agg(F.min("key").alias("cluster_key"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return d.join(names, ["ns", "pivot"]).select("cluster_key", "key")


def describe(ops: DataFrame, at: float = 0.80, typical: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(namespace, pivot, size, medoid, typical): each cluster with its most typical keys, those of the greatest mean cosine."""
    d = written(clusters(live_entries(ops), at, shard_rows).select("ns", "key", "pivot", F.round("score", 9).alias("score")), "clusters")
    best = Window.partitionBy("ns", "pivot").orderBy(F.desc("score"), "key")
    top = d.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= typical)
    top = top.groupBy("ns", "pivot").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "key"))), lambda s: s["key"]).alias("typical"))
    size = d.groupBy("ns", "pivot").agg(F.count(F.lit(1)).alias("size"))
    return size.join(top, ["ns", "pivot"]).select(F.col("ns").alias("namespace"), "pivot", "size", F.col("typical")[0].alias("medoid"), "typical")
