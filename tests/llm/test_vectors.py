"""Clustering, whitening and top-k search against plain whole-number forms."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from encore.llm import clustering, topk, vectors, whitening
from encore.llm.common import table
from tests.llm.conftest import CLASHING

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def frame(spark, rows, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for c in [*CLASHING, "q", "rank", "cluster", "dots", "component", "vector", "w"] if clash else []:
        df = df.withColumn(c, F.lit("clash"))
    return df


def odd_vectors(length, n=60, seed=5):
    """Repeated rows and ids, equal vectors, null ids, nulls, nan, infinities, empty and other lengths."""
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(0, 0.2, length).tolist()) for k in range(n)]
    rows += [(20, rows[20][1]), (40, rows[21][1]), (n, rows[3][1]), (n + 1, rows[3][1]), (None, rows[4][1]), (None, rows[4][1])]
    rows += [(n + 2, None), (n + 3, [None] * length), (None, None), (n + 4, [math.nan] + [0.1] * (length - 1)), (n + 5, [0.1] * (length - 1) + [-math.inf])]
    rows += [(n + 6, []), (n + 7, [0.5] * (length - 1)), (n + 8, [0.0] * length), (n + 9, [3000.25] * length), (-20, [-0.3] * length)]
    return rows


def whole(rows, factor):
    return [(i, [math.floor(factor * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def test_scaled():
    column = pa.array([[0.5, -0.1], None, [], [1.0, None], [math.inf], [2.0, 3.0, -4.01]], pa.list_(pa.float32()))
    rows, lengths, values = vectors.scaled(column, 4)
    assert rows.tolist() == [0, 2, 5] and lengths.tolist() == [2, 0, 3] and values.tolist() == [2, -1, 8, 12, -17]
    rows, x = vectors.of_length(column.slice(5), 4, 3, 1)
    assert rows.tolist() == [0] and x.tolist() == [[9, 13, -16]]
    with pytest.raises(ValueError):
        vectors.scaled(pa.array([[1e30]]), 4)


# ------------------------------------------------------------------ clustering
def plain_clusters(rows, length, count, rounds, factor=256, seed=2):
    x = [(i, v) for i, v in whole(rows, factor) if len(v) == length]
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in x if i is not None]
    centroids = [v for _, v in sorted(named)[:count]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))

    def nearest():
        return [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in x]

    for _ in range(rounds):
        own = nearest()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(x, own, strict=True) if c == k]
            if mine:
                centroids[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = nearest()
    total = sum(d for d, _ in own)
    inertia = {k: sum(d for d, c in own if c == k) for _, k in own}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], total, digest[k]) for (i, _), (d, k) in zip(x, own, strict=True)), key=str)


@pytest.mark.parametrize("count, rounds", [(7, 5), (7, 0), (1, 1), (500, 3)])
def test_clusters(spark, count, rounds):
    rows = odd_vectors(6)
    got = clustering.cluster_vectors(frame(spark, rows), length=6, centroids=count, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows, 6, count, rounds)


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, [0.5])], [(None, [0.1] * 64)]):
        got = clustering.cluster_vectors(frame(spark, rows))
        assert got.collect() == []
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="2\\^27"):
        clustering.cluster_vectors(frame(spark, [(1, [1e7] * 64)])).collect()


# ------------------------------------------------------------------ whitening
def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (5, 5), (12, 12), (12, 7), (33, 33)):
        half = rng.normal(0, 1, (d, rank)) * np.exp(rng.normal(0, 4, d))[:, None]
        v = half @ half.T
        order, factor = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v[np.ix_(order, order)], rtol=1e-10, atol=1e-12 * np.abs(v).max())
        assert np.allclose(np.triu(factor, 1), 0)
        values, own = whitening.principal(v)
        want = np.linalg.eigvalsh(v)[::-1][:rank]
        assert np.allclose(values, want, rtol=1e-8, atol=1e-12 * want[0]) and (np.diff(values) <= 0).all()
        assert np.allclose(own.T @ own, np.eye(rank), atol=1e-12)
        assert np.allclose(v @ own, own * values, atol=1e-11 * values[0])
    assert whitening.principal(np.zeros((3, 3)))[1].shape == (3, 0)


def covariance(x):
    """Exact covariance (divisor n) of whole numbers, as doubles."""
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    z = [[Fraction(n * a - s, n) for a, s in zip(r, sums, strict=True)] for r in x]
    return np.array([[float(sum(r[i] * r[j] for r in z) / n) for j in range(len(sums))] for i in range(len(sums))]), z, sums


def check_whitened(got, rows, d, components):
    x = [(i, [a + 1_000_000 for a in v]) for i, v in whole(rows, 64) if len(v) == d]
    n = len(x)
    v, z, sums = covariance([r for _, r in x])
    values, own = np.linalg.eigh(v)
    values, own = values[::-1], own[:, ::-1]
    m = min(components, d)
    assert len(got) == n * m and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    lists = {}
    for r in sorted(got, key=lambda r: r.component):
        lists.setdefault((r.vec_id, r.deviation), []).append(r)
    want = {}
    for (i, r), c in zip(x, z, strict=True):
        want.setdefault((i, sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))), []).append(np.array([float(e) for e in c]) @ own[:, :m] / np.sqrt(values[:m]))
    assert want.keys() == lists.keys()
    sign = None
    for k, w in want.items():
        if len(w) > 1:
            continue
        found = np.array([r.whitened for r in lists[k]])
        assert [r.component for r in lists[k]] == list(range(1, m + 1))
        if sign is None:
            sign = np.sign(found * w[0])
        assert np.allclose(found, sign * w[0], atol=1e-6)
        assert np.allclose([r.explained for r in lists[k]], values[:m] / np.trace(v), rtol=1e-8)


def test_whitened(spark):
    rows = odd_vectors(6)
    check_whitened(whitening.whitened(frame(spark, rows)).collect(), rows, 6, 32)
    check_whitened(whitening.whitened(frame(spark, rows), components=2).collect(), rows, 6, 2)


def test_whitened_table(spark):
    got = whitening.whitened(table(spark, DATA, "embeddings"))
    rows = [(r.vec_id, r.embedding) for r in table(spark, DATA, "embeddings").select("vec_id", "embedding").collect()]
    check_whitened(got.collect(), rows, 64, 32)


def test_whitened_far_vectors(spark):
    """Entries far apart: sums stay exact, deviations beyond a long are null."""
    rows = odd_vectors(4) + [(900, [1e9, 2e9, -1e9, 7.0]), (901, [3e9, 2e8, 5e9, 1e9])]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert any(r.deviation is None for r in got) and all(math.isfinite(r.whitened) for r in got)
    assert all(r.identity_error < 1e-4 for r in got) and abs(sum(r.explained for r in got if r.vec_id == 900) - 1) < 1e-9


def test_whitened_nothing(spark):
    for rows in ([], [(1, [])], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        got = whitening.whitened(frame(spark, rows))
        assert got.collect() == []
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = whitening.whitened(frame(spark, [(k, [k / 64, 2 * k / 64]) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9


# ------------------------------------------------------------------ top-k
def plain_top(rows, every, top):
    x = whole(rows, 64)
    out = []
    for a, (i, v) in enumerate(x):
        if i is None or i % every:
            continue
        scores = [(-sum(p * q for p, q in zip(v, w, strict=False)), j is None, j or 0) for b, (j, w) in enumerate(x) if a != b]
        out += [(i, k + 1, None if no else j, -s) for k, (s, no, j) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("every, top, block", [(20, 20, 4096), (20, 3, 1), (2, 5, 7), (1, 500, 4096)])
def test_top(spark, monkeypatch, every, top, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_SLICE", 3)
    monkeypatch.setattr(topk, "ROW_SLICE", 16)
    rows = odd_vectors(6)
    got = topk.top_rows(frame(spark, rows), every=every, top=top).collect()
    assert sorted(map(tuple, got), key=str) == plain_top(rows, every, top)


def test_top_of_ties(spark):
    """A large group of equal vectors: the smallest ids win, each query without itself."""
    rows = [(k, [0.25, 0.0, -0.5]) for k in range(300)]
    got = topk.top_rows(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain_top(rows, 20, 20)


def test_top_of_nothing(spark):
    for rows in ([], [(1, [0.5])], [(20, [0.5])], [(20, None), (40, [math.nan])]):
        got = topk.top_rows(frame(spark, rows))
        assert got.collect() == [] and got.columns == ["query_id", "rank", "vec_id", "score"]
