"""Neighbours and clusters against brute force, with one shard and with many."""

import numpy as np
import pytest

pytest.importorskip("karst.llm")
from karst.llm import clusters, neighbours, vectors  # noqa: E402
from karst.llm.hnsw import Hnsw  # noqa: E402

VEC = "key string, vector array<float>, ts_ms long, ns int, cell string, v1 string"


def blobs(rng, sizes, dim=24, spread=0.12):
    out = []
    for n in sizes:
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        out.append((c + spread * rng.standard_normal((n, dim)) / np.sqrt(dim) * 2) * rng.uniform(0.1, 9, (n, 1)))
    return np.concatenate(out).astype(np.float32)


def entries(seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = []
    for ns, sizes in (("a:", [40, 25, 12, 3, 2] + [1] * 60), ("b:c:", [60] + [1] * 30)):
        x = blobs(rng, sizes)
        rows += [(f"{ns}{i:03}", [float(v) for v in r], 10) for i, r in enumerate(x)]
        rows += [(f"{ns}copy{i:03}", rows[-1][1], 10) for i in range(copies)]
    rows += [rows[0], (rows[3][0], [9.0] * 24, 1), (rows[4][0], rows[4][1], None)]  # repeated, older and undated rows
    rows += [("a:null", None, 1), ("a:empty", [], 1), ("a:zero", [0.0] * 24, 1), ("a:nan", [float("nan")] * 24, 1), ("a:inf", [float("inf")] + [0.0] * 23, 1), ("a:short", [1.0] * 5, 1), (None, [1.0] * 24, 1), ("nocolon", [1.0] * 24, 1)]
    return [(*r, 7, "x", "y") for r in rows]


def current(rows):
    best = {}
    for k, v, t, *_ in rows:
        if k is not None and (k not in best or (t or -1, v or []) > (best[k][0], best[k][1] or [])):
            best[k] = (t or -1, v)
    by = {}
    for k, (_, v) in best.items():
        if v:
            by.setdefault(k[: k.rfind(":") + 1], []).append((k, v))
    for ns, items in by.items():
        n = [len(v) for _, v in items]
        usual = max(sorted(set(n)), key=n.count)
        ok = [(k, np.array(v, float)) for k, v in sorted(items) if len(v) == usual and np.isfinite(v).all() and np.any(v)]
        keys, x = [k for k, _ in ok], np.array([v / np.linalg.norm(v) for _, v in ok])
        yield keys, np.round(x @ x.T, 9)


def true_pairs(rows, k=10):
    out = set()
    for keys, c in current(rows):
        for i, a in enumerate(keys):
            near = sorted((j for j in range(len(keys)) if j != i and c[i, j] >= 0.8), key=lambda j: (-c[i, j], keys[j]))[:k]
            out |= {(min(a, keys[j]), max(a, keys[j])) for j in near}
    return out


@pytest.mark.parametrize(("shard_rows", "copies"), [(32_768, 0), (60, 0), (32_768, 40), (60, 40)])
def test_pairs(spark, shard_rows, copies):
    rows = entries(3, copies)
    got = [tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, VEC), shard_rows=shard_rows).collect()]
    want = true_pairs(rows)
    assert len(got) == len(set(got)) and len(set(got) & want) >= 0.97 * len(want) and len(set(got) - want) <= 0.03 * len(want)


@pytest.mark.parametrize("shard_rows", [32_768, 60])
def test_many_vectors_of_one_direction(spark, shard_rows):
    # Their cosines are all 1, so among more of them than the graph's candidates the smaller keys must be chosen.
    rng = np.random.default_rng(2)
    v = rng.standard_normal(24)
    rows = [(f"a:{i:03}", [float(x) for x in v * f], 10) for i, f in enumerate(rng.uniform(0.01, 50, 90))]
    rows += [(f"a:x{i:03}", [float(x) for x in r], 10) for i, r in enumerate(blobs(rng, [30] + [1] * 40))]
    rows = [(*r, 7, "x", "y") for r in rows]
    got = {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, VEC), shard_rows=shard_rows).collect()}
    want = true_pairs(rows)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_empty_and_tiny(spark):
    none = spark.createDataFrame([], VEC)
    assert neighbours.similar_pairs(none).count() == 0
    one = spark.createDataFrame([("a:1", [1.0, 0.0], 1, 1, "", "")], VEC)
    assert neighbours.similar_pairs(one).count() == 0
    two = spark.createDataFrame([("a:1", [1.0, 0.0], 1, 1, "", ""), ("a:2", [2.0, 0.1], 1, 1, "", ""), ("b:1", [1.0, 0.0], 1, 1, "", "")], VEC)
    assert [tuple(r) for r in neighbours.similar_pairs(two).collect()] == [("a:1", "a:2")]


def test_graph_recall_without_threshold():
    rng = np.random.default_rng(5)
    for x in (rng.standard_normal((400, 48)), np.concatenate([blobs(rng, [50] * 4, 32)])):
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        ids, sim = Hnsw(x).search_self(10, 100)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        want = np.argsort(-s, axis=1)[:, :10]
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want)]) >= 0.9
        cold, _ = Hnsw(x).search(x[:50], 1, 60)
        assert np.mean(cold[:, 0] == np.arange(50)) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65, 200])
def test_graph_of_any_size(n):
    x = np.random.default_rng(n).standard_normal((n, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, sim = Hnsw(x).search_self(3)
    assert ids.shape == (n, 3) and (ids[:, 0] >= 0).all() == (n > 1)


def true_clusters(rows):
    out = set()
    for keys, c in current(rows):
        a = c >= 0.8
        for i, k in enumerate(keys):
            m = np.flatnonzero(a[i])
            if len(m) >= 3 and m[0] == i and a[np.ix_(m, m)].all() and (a[m].sum(1) == len(m)).all():
                out |= {(k, keys[j]) for j in m}
    return out


OPS = "op_id long, op string, key string, vector array<float>, ts_ms long, namespace string, n int"


def operations(seed, copies=0):
    rows = [(i, " Insert", k, v, t, None, 1) for i, (k, v, t, *_) in enumerate(entries(seed, copies))]
    return rows + [(9000, "delete", "a:001", None, 99, None, 1), (9001, None, "a:002", rows[2][3], 99, "a:", 1)]


@pytest.mark.parametrize(("shard_rows", "copies"), [(32_768, 0), (60, 0), (32_768, 30), (60, 30)])
def test_tight_clusters(spark, shard_rows, copies):
    rows = operations(8, copies)
    d = spark.createDataFrame(rows, OPS)
    got = {tuple(r) for r in clusters.tight_clusters(d, shard_rows=shard_rows).collect()}
    want = true_clusters([(k, v, t) for _, op, k, v, t, *_ in rows if (k, t) != ("a:001", 10) and op != "delete"])
    assert got == want and len(want) > 100


def greedy(rows, at=0.8):
    """Members, sizes and medoids by taking keys one by one in order of hash."""
    import hashlib

    out = {}
    for keys, c in current(rows):
        order = sorted(range(len(keys)), key=lambda i: (hashlib.sha256(keys[i].encode()).hexdigest()[:15], keys[i]))
        heads = []
        for i in order:
            if not any(c[i, p] >= at for p in heads):
                heads.append(i)
        members = {}
        for i in range(len(keys)):
            members.setdefault(i if i in heads else max(heads, key=lambda p: (c[i, p], -order.index(p))), []).append(i)
        ns = keys[0][: keys[0].rfind(":") + 1]
        out |= {(ns, keys[p]): [keys[i] for i in m] for p, m in members.items()}
    return out


@pytest.mark.parametrize("shard_rows", [32_768, 60])
def test_clusters_are_those_of_the_greedy_order(spark, shard_rows):
    rng = np.random.default_rng(12)
    x = np.concatenate([blobs(rng, [40, 25, 9], spread=0.9), blobs(rng, [30] + [1] * 40), rng.standard_normal((30, 24)).astype(np.float32)])
    rows = [(i, "insert", f"a:{i:03}", [float(v) for v in r], 10, None, 1) for i, r in enumerate(x)]
    rows += [(900 + i, "insert", f"a:copy{i}", rows[3][3], 10, None, 1) for i in range(30)]
    want = greedy([(k, v, t) for _, _, k, v, t, *_ in rows])
    d = spark.createDataFrame(rows, OPS)
    got = clusters.clusters(clusters.live_entries(d), shard_rows=shard_rows).collect()
    found = {}
    for r in got:
        found.setdefault((r.ns, r.pivot), []).append(r.key)
    as_sets = lambda c: {frozenset(v) for v in c.values()}
    assert as_sets(found) == as_sets(want) and {r["size"] for r in clusters.describe(d, shard_rows=shard_rows).collect()} == {len(v) for v in want.values()}


def test_described_alike_in_one_shard_and_in_many(spark):
    d = spark.createDataFrame(operations(8, 30), OPS)
    one, many = ({tuple(map(str, r)) for r in clusters.describe(d, shard_rows=n).collect()} for n in (32_768, 60))
    assert one == many


def test_chain_is_no_cluster_and_all_keys_are_described(spark):
    angle = np.arange(12) * 0.3
    rows = [(i, "insert", f"a:{i:02}", [float(np.cos(a)), float(np.sin(a))], 1, None, 1) for i, a in enumerate(angle)]
    d = spark.createDataFrame(rows, OPS)
    assert clusters.tight_clusters(d).count() == 0
    for shard_rows in (32_768, 5):
        got = clusters.describe(d, shard_rows=shard_rows).collect()
        assert sum(r["size"] for r in got) == 12 and all(r.medoid == r.typical[0] and 1 <= len(r.typical) <= 3 for r in got)
    members = {r.key: r.pivot for r in clusters.clusters(clusters.live_entries(d)).collect()}
    at = {f"a:{i:02}": a for i, a in enumerate(angle)}
    assert all(np.cos(at[k] - at[p]) >= 0.8 - 1e-6 for k, p in members.items())
    assert clusters.describe(d.limit(0)).count() == 0


def test_shards_index_every_row_once(spark):
    rows = vectors.current_entries(spark.createDataFrame(entries(2), VEC))
    parts = vectors.shards(rows, 40)
    assert parts.several.filter("home").count() + parts.single.count() == rows.count()
    assert parts.several.filter("home").groupBy("key").count().filter("count > 1").count() == 0


def test_pivots_are_joined_where_they_are_many(spark, monkeypatch):
    rows = vectors.current_entries(spark.createDataFrame(entries(2), VEC))
    form = lambda: sorted(map(str, vectors.shards(rows, 40).several.drop("vector").collect()))
    sent = form()
    monkeypatch.setattr(vectors, "PIVOT_BYTES", 0)
    assert form() == sent and len(sent) > 100


def test_long_vectors_have_smaller_shards(spark):
    d = spark.createDataFrame([([1.0] * n,) for n in (64, 1536, 100_000)], "vector array<float>")
    assert [r.m for r in d.select(vectors.row_limit(vectors.SHARD_ROWS).alias("m")).collect()] == [32_768, 2_730, 64]


def bridged(n=24, dim=16):
    """Two dense groups, of which one row each is similar to one of the other but has more than 16 nearer ones, and a group apart."""
    rng = np.random.default_rng(4)
    angle = lambda a: np.eye(dim)[0] * np.cos(a) + np.eye(dim)[1] * np.sin(a)
    a = [angle(0.0) + 0.01 * rng.standard_normal(dim) for _ in range(n)] + [angle(0.16)]
    b = [angle(0.92) + 0.01 * rng.standard_normal(dim) for _ in range(n)] + [angle(0.76)]
    c = [np.eye(dim)[5] + 0.01 * rng.standard_normal(dim) for _ in range(n)]
    rows = [(f"a:{g}{i:02}", [float(v) for v in r], 10) for g, x in (("a", a), ("b", b), ("c", c)) for i, r in enumerate(x)]
    return [(i, "insert", k, v, t, None, 1) for i, (k, v, t) in enumerate(rows)]


@pytest.mark.parametrize("shard_rows", [32_768, 30])
def test_dense_groups_that_touch_beyond_their_nearest_rows(spark, shard_rows):
    rows = bridged()
    got = {tuple(r) for r in clusters.tight_clusters(spark.createDataFrame(rows, OPS), shard_rows=shard_rows).collect()}
    assert got == true_clusters([(k, v, t) for _, _, k, v, t, *_ in rows]) and len(got) == 24


@pytest.mark.parametrize("shard_rows", [32_768, 60])
def test_members_are_with_the_closest_pivot(spark, shard_rows):
    x = np.random.default_rng(6).standard_normal((150, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, "insert", f"a:{i:03}", [float(v) for v in r], 1, None, 1) for i, r in enumerate(x)]
    d = clusters.clusters(clusters.live_entries(spark.createDataFrame(rows, OPS)), shard_rows=shard_rows).collect()
    pivot = {int(r.key[2:]): int(r.pivot[2:]) for r in d}
    heads = sorted(set(pivot.values()))
    s = x @ x[heads].T
    assert len(pivot) == 150 and all(s[i].max() - x[i] @ x[p] < 1e-6 and x[i] @ x[p] >= 0.8 - 1e-6 for i, p in pivot.items())


def test_vectors_are_written_once_whatever_the_pairs_of_blocks(spark, monkeypatch):
    # Disk must not grow with the pairs of blocks, nor with the rounds.
    real, tables = clusters.written, []

    def spy(d, *more):
        tables.append(real(d, *more))
        return tables[-1]

    monkeypatch.setattr(clusters, "written", spy)
    d = spark.createDataFrame(operations(8, 30), OPS)
    assert clusters.clusters(clusters.live_entries(d), shard_rows=30).count() > 100
    assert sum(t.count() for t in tables if {"vector", "centre", "mean"} & set(t.columns)) <= d.count()
