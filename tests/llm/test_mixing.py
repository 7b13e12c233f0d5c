"""Mixing against a plain computation of the targets."""

import re

from pyspark.sql import functions as F

from encore.llm import mixing
from tests.llm.conftest import documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def count(text):
    return len(WORD.findall(text or ""))


def plain_targets(sizes, weights, total, epochs):
    targets, capped = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(epochs * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i in range(len(sizes)) if i not in capped and rest * weights[i] / weight > epochs * sizes[i]}
        if not over:
            break
        capped |= over
    for i in range(len(sizes)):
        targets[i] = epochs * sizes[i] if i in capped else rest * weights[i] / weight
    return targets


def test_water_filling():
    sizes = [10, 1000, 5, 400, 50]
    weights = [5, 2, 1, 5, 2]
    got = mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2.0)
    want = plain_targets(sizes, weights, 1.5 * sum(sizes), 2.0)
    assert all(abs(a - b) < 1e-9 * sum(sizes) for a, b in zip(got, want, strict=True))
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6
    assert mixing.water_fill([], [], 0, 2.0) == [] and mixing.water_fill([0], [5], 0, 2.0) == [0]


def test_mix(spark, odd_rows):
    rows = odd_rows + [(100 + k, " ".join(words(k, 5 + 7 * k)), "en", f"s{k % 4}") for k in range(80)]
    df = documents(spark, rows, clash=True)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(count(t) for _, t, _, s in rows if s == name) for name in order]
    want = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes), 2.0)
    for name, size, target in zip(order, sizes, want, strict=True):
        own = [r for r in got if r.source == name]
        assert {r.source_size for r in own} == {size}
        assert all(abs(r.target - target) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        # at most one document of a source is taken in part
        assert sum(r.taken % r.size > 0 for r in own if r.size) <= 1


def test_apply_takes_what_the_mix_says(spark):
    rows = [(k, " ".join(words(k, 5 + 3 * k)), "en", f"s{k % 5}") for k in range(60)]
    df = documents(spark, rows)
    mixed = mixing.mix(df)
    out = mixing.apply_mix(df, mixed)
    assert out.columns == df.columns
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + count(r.text)
        assert r.n_chars == len(r.text)
    assert got == {i: t for i, t in taken.items() if t}


def test_apply_tells_rows_without_or_of_one_doc_id_apart(spark):
    """Null and repeated doc_ids of several sources and sizes: each source gets what the mix takes of it, each text its own."""
    rows = [(k, " ".join(words(k, 5 + 3 * k)), "en", f"s{k % 5}") for k in range(30)]
    rows += [(None, " ".join(words(100 + k, 4 + k)), "en", f"s{k % 5}") for k in range(25)]
    rows += [(7, " ".join(words(200 + k, 11)), "en", f"s{k % 5}") for k in range(10)]
    rows += [(None, "the same five words again", "en", f"s{k % 2}") for k in range(9)] + [(None, None, "en", "s1"), (None, "", None, None)]
    df = documents(spark, rows)
    mixed = mixing.mix(df)
    sums = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum("taken").alias("t")).collect() if r.t}
    out = mixing.apply_mix(df, mixed).collect()
    got = {}
    for r in out:
        got[r.source] = got.get(r.source, 0) + count(r.text)
    assert got == sums
    whole = {(i, t, s) for i, t, _, s in rows}
    cut = [r for r in out if (r.doc_id, r.text, r.source) not in whole]
    assert len(cut) <= len(sums)
    size = {}
    for r in mixed.collect():
        size.setdefault((r.doc_id, r.source, r.mark), []).append(r.taken // r.size if r.size else 0)
    assert len(out) - len(cut) == sum(map(sum, size.values()))


def test_empty(spark, none):
    assert mixing.mix(none).collect() == []
    blank = documents(spark, [(1, None, None, "a"), (2, "", None, None)])
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.apply_mix(blank, mixing.mix(blank)).count() == 0
    assert mixing.mix_rows(blank).filter(F.col("taken") > 0).count() == 0
