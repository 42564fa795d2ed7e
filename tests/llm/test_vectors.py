"""Whitening, top-k search and clustering of embeddings against brute force."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from cases import folder  # noqa: F401
from pyspark.sql import functions as F

from fieldline.llm import topk, whitening, zonemaps

# Names that clash with internal ones.
SCHEMA = "vec_id long, embedding array<float>, label int, x string, block int, v int, place long, ids string, score long, cluster int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2, 3, "i", 4, 5) for i, v in rows], SCHEMA)


def single(v):
    """The doubles that a column of floats holds."""
    return [float(np.float32(c)) for c in v]


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def whole(v, scale, shift=0):
    return [math.floor(scale * c) + shift for c in single(v)]


@pytest.fixture(scope="module")
def embeddings(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet").cache()


@pytest.fixture(scope="module")
def stored(embeddings):
    return [(r.vec_id, r.embedding) for r in embeddings.collect()]


def edge_rows(length=6, seed=4):
    draw = random.Random(seed)
    some = lambda n=length: [draw.uniform(-1, 1) for _ in range(n)]
    same = some()
    rows = [(k, some()) for k in range(1, 60)]
    rows += [(100 + k, same) for k in range(40)] + [(100, same), (100, same)]
    rows += [(200, None), (201, [None] * length), (202, [0.5] * (length - 1) + [None]), (203, [float("nan")] + same[1:]), (204, [float("-inf")] + same[1:])]
    rows += [(None, some()), (None, same), (205, some(length - 2)), (206, []), (0, [0.0] * length), (-20, some())]
    return rows


# Whitening


def eigen(a, many):
    values, vectors = np.linalg.eigh(a)
    return values[::-1][:many], vectors[:, ::-1][:, :many]


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "diagonal", "rank one", "nought", "one", "two"])
def test_leading_eigenvectors(kind):
    draw = np.random.default_rng(3)
    q = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    a = {
        "random": lambda: np.cov(draw.normal(size=(40, 300))),
        "clustered": lambda: (q * np.append(1 + 1e-12 * np.arange(20), np.linspace(0.1, 0.5, 20))) @ q.T,
        "equal": lambda: np.eye(40) * 3.0,
        "diagonal": lambda: np.diag(np.arange(40.0)),
        "rank one": lambda: np.outer(q[0], q[0]),
        "nought": lambda: np.zeros((40, 40)),
        "one": lambda: np.array([[2.5]]),
        "two": lambda: np.array([[2.0, -1.0], [-1.0, 2.0]]),
    }[kind]()
    a = (a + a.T) / 2
    values, vectors = whitening.leading(a, 16)
    want = eigen(a, 16)[0]
    size = max(np.abs(a).max(), 1e-300)
    assert len(values) == min(16, len(a)) and np.allclose(values, want, rtol=0, atol=1e-13 * size * len(a))
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12


def test_sturm_counts_eigenvalues_below():
    draw = np.random.default_rng(5)
    d, e = draw.normal(size=30), draw.normal(size=29)
    e[7] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = draw.normal(size=50) * 3
    assert whitening.sturm_counts(d, e, at).tolist() == [(values < t).sum() for t in at]


def check_whitening(rows, got, many=16):
    width = max([len(v) for _, v in rows if usable(v)], default=0)
    kept = [(i, whole([*v, *[0.0] * (width - len(v))], 64, 1_000_000)) for i, v in rows if usable(v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit]).reshape(n, width)
    cov = z.T @ z / n
    values, vectors = eigen(cov, many) if n and width else (np.zeros(0), None)
    trace = float(np.trace(cov)) if n else 0
    values = values[values > 1e-12 * trace] if trace else values[:0]
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k + 1) for i, _ in kept for k in range(len(values)))
    want = {}
    for i, x in kept:
        want.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), x))
    errors = {r.identity_error for r in got}
    assert len(errors) <= 1 and all(e <= 1e-9 for e in errors)
    sign = {}
    for r in got:
        k = r.component - 1
        assert r.n == n and abs(r.explained - values[k] / trace) <= 1e-9 * r.explained
        options = [x for d, x in want[r.vec_id] if d == r.deviation]
        assert options
        gap = np.diff(np.append(values, 0))[k] if k < len(values) else 0
        if len(want[r.vec_id]) == 1 and (k == 0 or values[k - 1] - values[k] > 1e-6 * values[0]) and -gap > 1e-6 * values[0]:
            plain = float(np.array([float(Fraction(n * a - s, n)) for a, s in zip(options[0], sums)]) @ vectors[:, k] / np.sqrt(values[k]))
            if abs(plain) > 1e-3:
                sign.setdefault(k, np.sign(plain) * np.sign(r.whitened))
            assert abs(plain - sign.get(k, 1) * r.whitened) < 1e-6 or abs(plain) <= 1e-3 and abs(abs(plain) - abs(r.whitened)) < 1e-6


def test_whitening_equals_brute_force(embeddings, stored):
    check_whitening(stored, whitening.whiten(embeddings.repartition(3)).collect())


def test_whitening_of_edge_rows(spark):
    rows = edge_rows()
    got = whitening.whiten(frame(spark, rows).repartition(4)).collect()
    check_whitening(rows, got)
    assert {r.component for r in got} == set(range(1, 7))
    for few in ([], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [])]):
        assert whitening.whiten(frame(spark, few)).collect() == []
    line = [(k, [k * 0.25, 1.0]) for k in range(5)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in got} == {1} and {r.explained for r in got} == {1.0}


def test_deviations_are_exact_or_null(spark):
    rows = [(1, [3e15, 0.0]), (2, [-3e15, 1.0]), (3, [0.0, 2.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).collect() if r.component == 1}
    assert got[1] is None and got[2] is None and got[3] is not None


# Top-k


def best(rows, k=20, queries=lambda i: i % 20 == 0):
    kept = [(i, whole(v, 64)) for i, v in rows if usable(v)]
    out = Counter()
    for q, a in kept:
        if q is None or not queries(q):
            continue
        scored = sorted(
            ((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in kept if i is None or i != q)
        )
        out.update((q, n + 1, None if missing else i, -s) for n, (s, missing, i) in enumerate(scored[:k]))
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_top_k_equals_brute_force(embeddings, stored, block_rows):
    assert found(topk.top_k(embeddings, block_rows=block_rows)) == best(stored)


@pytest.mark.parametrize("block_rows", [5, 64])
def test_top_k_of_edge_rows(spark, block_rows):
    rows = edge_rows()
    docs = frame(spark, rows).repartition(3)
    assert found(topk.top_k(docs, block_rows=block_rows)) == best(rows)
    got = found(topk.top_k(docs, F.col("vec_id") >= 0, k=3, block_rows=block_rows))
    assert got == best(rows, 3, lambda i: i >= 0)
    for few in ([], [(20, None)], [(20, [1.0])], [(20, []), (1, [])], [(1, [1.0]), (2, [1.0])], [(20, [1.0]), (1, [2.0])]):
        assert found(topk.top_k(frame(spark, few), block_rows=block_rows)) == best(few)


def test_top_k_of_large_components_is_exact(spark):
    rows = [(20, [2.0**24, 2.0**-6, 1.0]), (1, [2.0**24, 2.0**-6, 1.0]), (2, [2.0**24, 2.0**-5, 1.0]), (3, [2.0**24, 0.0, 1.0]), (4, [-(2.0**20), 0.0, 0.0])]
    assert found(topk.top_k(frame(spark, rows))) == best(rows)
    huge = [(20, [1e20]), (1, [1e20]), (2, [2e20]), (3, [-1e20])]
    got = [(r.vec_id, r.score) for r in topk.top_k(frame(spark, huge)).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, 2**63 - 1), (3, 1 - 2**63)]


def test_cutoff_leaves_out_no_sufficient_entry():
    draw = np.random.default_rng(2)
    for kind in (np.int64, np.float32, object):
        q, x = draw.integers(-5, 6, (8, 12)), draw.integers(-5, 6, (300, 12))
        parts = [p.astype(kind) for p in topk.partial_scores(q, x)]
        own = draw.random((8, 300)) < 0.02
        full = q @ x.T
        row, score = topk.gathered_scores(parts, own, 4)
        for i in range(8):
            ranked = np.sort(full[i][~own[i]])[::-1]
            assert (np.sort(score[row == i])[::-1] <= ranked[:4]).all()
        cutoff, known = np.array([score[row == i].min() for i in range(8)]), np.arange(8) != 3
        row, at, score = topk.sufficient_entries(parts, own, cutoff, known)
        want = {(i, j) for i in range(8) for j in range(300) if not own[i, j] and (not known[i] or full[i, j] >= cutoff[i])}
        assert set(zip(row.tolist(), at.tolist())) == want and (score == full[row, at]).all()


# Clustering


def lloyd(rows, k=8, rounds=10, length=64):
    kept = [(i, whole(v, 1024)) for i, v in rows if usable(v) and len(v) == length]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1])
    centres = [x for _, x in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        centres = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else old for j, old in enumerate(centres)]
    last = [(i, *near(x)) for i, x in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), names[j]) for i, d, j in last)


def clustered(df):
    return Counter(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clustering_equals_brute_force(embeddings, stored):
    assert clustered(zonemaps.cluster(embeddings.repartition(5), block_rows=16)) == lloyd(stored)


def test_clustering_of_edge_rows(spark):
    rows = edge_rows()
    docs = frame(spark, rows).repartition(3)
    assert clustered(zonemaps.cluster(docs, length=6, block_rows=8)) == lloyd(rows, length=6)
    assert clustered(zonemaps.cluster(docs, k=3, rounds=2, length=6)) == lloyd(rows, 3, 2, 6)
    grid = [(k, [float(k % 3), float(k % 2)]) for k in range(30)]  # ties and equal first centroids
    assert clustered(zonemaps.cluster(frame(spark, grid), length=2, block_rows=4)) == lloyd(grid, length=2)
    for few in ([], [(1, None)], [(1, [0.5] * 6)], [(None, [0.5] * 6), (2, [0.25] * 6), (2, [0.125] * 6)]):
        assert clustered(zonemaps.cluster(frame(spark, few), length=6)) == lloyd(few, length=6)


def test_clustering_of_large_components_is_exact(spark):
    rows = [(k, [2.0**17 * (k % 5) + k, -(2.0**14) * k]) for k in range(40)]
    assert clustered(zonemaps.cluster(frame(spark, rows), length=2)) == lloyd(rows, length=2)


def test_box_bounds_keep_every_nearest_centroid():
    draw = np.random.default_rng(8)
    for _ in range(50):
        x, c = draw.integers(-50, 50, (30, 5)) // draw.integers(1, 10), draw.integers(-60, 60, (8, 5))
        among = zonemaps.candidate_centroids(x.min(axis=0), x.max(axis=0), c)
        number, distance = zonemaps.nearest(x, c, among)
        plain = ((x[:, None] - c) ** 2).sum(axis=2)
        assert (number == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


@pytest.mark.parametrize("bits, dims", [(3, 2), (2, 3), (1, 5), (4, 2)])
def test_hilbert_neighbours_are_one_step_apart(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = zonemaps.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    ordered = cells[np.array(sorted(range(len(cells)), key=keys.__getitem__))]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_skip_comparisons(spark):
    """On data that is spread along few directions most blocks have one centroid to look at."""
    draw = np.random.default_rng(1)
    rows = [(k, [float(c), float(c), 0.0]) for k, c in enumerate(draw.uniform(0, 1, 2_000))]
    stored = zonemaps.whole_vectors(frame(spark, rows), "embedding", "vec_id", 1024, length=3)
    zones = zonemaps.blocks(zonemaps.along_curve(stored, 3, 0, 1024), 3, 50, zones=True).collect()
    centroids = np.array([[1024 * j // 8, 1024 * j // 8, 0] for j in range(8)])
    single_ = [len(zonemaps.candidate_centroids(np.array(z.low), np.array(z.high), centroids)) == 1 for z in zones]
    assert sum(len(z.ids) for z in zones) == 2_000 and sum(single_) > len(zones) / 3
