"""Near duplicates against brute force over all pairs of shingle sets."""

import re

import numpy as np
import pyarrow as pa
from tests.llm.conftest import words
from pyspark.sql import functions as F

from encore.llm import minhash
from encore.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute(rows):
    """{doc_id: component} over rows (doc_id, text); rows with one doc_id are one document."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id), r
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingle_set(t)) for _, t in rows)


def test_odd_rows(spark, odd, odd_rows, none):
    want = brute([(i, t) for i, t, *_ in odd_rows])
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows) and all(r.component_id == want.get(r.doc_id) for r in got)
    assert minhash.near_duplicates(none).collect() == []
    kept = minhash.unique_rows(odd).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    # unlike texts under one doc_id (13) are documents of their own
    assert sorted(ids) == sorted([*{i for i, c in want.items() if i == c}, 13])
    assert sum(r.doc_id is None for r in kept) == 2


def test_families_of_copies(spark):
    """Copies around a template at all distances: chains of links, groups beside each other."""
    rng = np.random.default_rng(4)
    rows = []
    for family in range(4):
        base = words(family, 120)
        for k in range(40):
            own = list(base)
            for _ in range(rng.integers(0, 9)):
                own[rng.integers(len(own))] = f"new{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, " ".join(words(100 + k, 80))) for k in range(60)]
    check(spark, rows)


def test_chain_where_ends_differ(spark):
    """a-b and b-c are linked, a-c is not."""
    base = words(7, 100, 10**6)
    texts = [list(base) for _ in range(9)]
    for k, t in enumerate(texts):
        t[: 5 * k] = [f"x{j}" for j in range(5 * k)]
    check(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])


def test_links_of_a_family_grow_in_proportion(spark, monkeypatch):
    """A family whose similarities lie around the threshold: the links written follow the documents, not their pairs."""
    written = {}

    def counted(links):
        written[counted.size] = max(written.get(counted.size, 0), links.count())
        return components(links)

    monkeypatch.setattr(minhash, "components", counted)
    for counted.size in (100, 200, 400):
        rng = np.random.default_rng(counted.size)
        base = words(3, 120, 10**6)
        rows = []
        for k in range(counted.size):
            own = list(base)
            for at in rng.choice(len(own), 3, replace=False):
                own[at] = f"new{k}_{at}"
            rows.append((k, " ".join(own)))
        check(spark, rows)
    assert all(n < 2 * size for size, n in written.items()), written


def test_unlike_texts_of_one_doc_id_are_kept(spark):
    """A doc_id is no near duplicate of itself: only like texts go, and rows of other columns' types are carried."""
    a, b = " ".join(words(1, 60)), " ".join(words(2, 60))
    rows = [(1, a, {"k": 1}), (1, b, {"k": 2}), (1, a, {"k": 1}), (2, b, {"k": 3}), (3, a, None), (None, a, None), (None, None, None)]
    rows += [(4, None, None), (4, "", None), (5, b + " end", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    got = minhash.unique_rows(df)
    assert got.columns == df.columns
    found = [(r.doc_id, r.text) for r in got.collect() if r.doc_id is not None]
    assert (1, a) in found and sum(t in (b, b + " end") for _, t in found) == 1
    assert sum(i == 4 for i, _ in found) == 2 and len(found) == 4
    assert got.filter("doc_id is null").count() == 2


def test_estimate_is_near_the_truth(spark):
    base = words(9, 400, 10**6)
    other = base[:300] + words(10, 100, 10**6)
    column = pa.array([" ".join(base), " ".join(other)])
    sets, before = minhash.distinct_sets(column)
    least = np.stack([minhash.minima(sets[before[i] : before[i + 1]]) for i in range(2)])
    packed, bands = minhash.signatures(least)
    assert packed.shape == (2, minhash.SIGNATURE) and bands.shape == (2, minhash.BANDS)
    df = spark.createDataFrame([tuple(list(map(int, row.view(np.int64))) for row in packed)], "a array<long>, b array<long>")
    got = df.select(minhash.estimate(F.col("a"), F.col("b")).alias("e")).first().e
    x, y = shingle_set(" ".join(base)), shingle_set(" ".join(other))
    assert abs(got - len(x & y) / len(x | y)) < 0.15


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 50), (50, 75), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, 50: 50, 75: 50, 100: 50, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
