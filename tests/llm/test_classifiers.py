"""Quality, toxicity and language: gradients, plain formulas, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from encore.llm import bytegru, language, quality, statistics, textcnn, toxicity
from encore.llm.common import table, text_bytes

DATA = "/root/testdata/sf0.01"


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


# ------------------------------------------------------------------ quality
def test_statistics_do_not_depend_on_neighbours():
    texts = ["a b a b a b\nc", None, "", "X!! Y!! Z!!", "one", "### $$$ %%% a b", "a b a b a b\nc", "é è 12 3."]
    whole = statistics.statistics(pa.array(texts))
    alone = np.concatenate([statistics.statistics(pa.array([t], pa.string())) for t in texts])
    assert whole.shape == (len(texts), len(statistics.NAMES)) and np.isfinite(whole).all()
    assert np.allclose(whole, alone) and np.allclose(whole[0], whole[6]) and np.allclose(whole[1], whole[2])


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    d = len(statistics.NAMES)
    x = {0: rng.normal(0, 2, (500, d)), 1: rng.normal(1, 1, (900, d))}
    model = quality.Discriminant.from_moments({c: (float(len(v)), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in x.values()) / 1400
    points = rng.normal(0.5, 2, (50, d))
    density = []
    for v in x.values():
        cov = (1 - quality.TO_POOLED - quality.TO_UNIT) * np.cov(v.T, bias=True) + quality.TO_POOLED * pooled
        cov += np.diag(quality.TO_UNIT * np.diag(pooled) + 1e-6)
        e = points - v.mean(axis=0)
        density.append(np.log(len(v) / 1400) - 0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(cov), e) + np.linalg.slogdet(cov)[1]))
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))
    assert np.allclose(model.score(points), want, atol=1e-9)


def test_quality_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if remainder(r.doc_id, 3) == 1]
    assert held and all(r.held_out == (remainder(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    # held-out labels change nothing
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_quality(docs.withColumn("lang", F.lit(None)), other).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_quality_learns_from_a_sample(spark, monkeypatch):
    """The filter learns from a bounded sample of the labels, and judges every row."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    whole = {r.doc_id for r in quality.good_rows(docs, labels).select("doc_id").collect()}
    assert whole == {r.doc_id for r in quality.score_quality(docs, labels).filter("predicted = 1").collect()}
    known = quality.labelled(labels, "quality", 3, 1)
    assert 60 < quality.sampled(known, 100).count() < 140 and quality.sampled(known, 10**6).count() == known.count()
    part = {r.doc_id for r in quality.good_rows(docs, labels, 150).select("doc_id").collect()}
    assert len(part ^ whole) < 0.05 * docs.count()


def test_quality_odd_rows(spark, odd, odd_rows, none, labels):
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len({round(r.score, 12) for r in got if r.doc_id in (4, 5)}) == 1
    assert quality.score_quality(none, labels).collect() == []
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(odd, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality.good_rows(odd, labels.limit(0)).columns == odd.columns


# ------------------------------------------------------------------ toxicity
def test_convolution_by_tables_is_the_plain_one():
    model = textcnn.TextCnn()
    texts = ["one two three four five", "", "a", "b c", None, "last one here"]
    word, stem, before = textcnn.tokens(pa.array(texts))
    got = model.logits(word, stem, before)
    for k in range(len(texts)):
        w, s = word[before[k] : before[k + 1]], stem[before[k] : before[k + 1]]
        x = model.words[w] + model.stems[s] if len(w) else np.zeros((1, textcnn.DIM), np.float32)
        x = np.concatenate([x, np.zeros((2, textcnn.DIM), np.float32)])
        pooled = []
        for width in textcnn.WIDTHS:
            z = [sum(x[t + j] @ model.filters[width][j] for j in range(width)) for t in range(max(len(w), 1))]
            pooled.append(np.max(z, axis=0) + model.bias[width])
        want = np.maximum(np.concatenate(pooled), 0) @ model.out + model.out_bias
        assert abs(got[k] - want) < 1e-4


def test_toxicity_learns_words_in_context(spark):
    from tests.llm.conftest import documents, words

    rows, marks = [], []
    for k in range(700):
        bad = k % 4 == 0
        body = words(k, 40)
        if bad:
            body[k % 40] = ("vile" if k % 8 else "nasty") + ("" if k % 16 else "ness")
        rows.append((k, " ".join(["the", "of", *body]) if k % 3 else " ".join(["der", "und", *body]), "en", "s"))
        marks.append((k, 1, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(documents(spark, rows, clash=True), labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_toxicity_held_out(spark, size):
    """On the given labels, of which a tenth is toxic: 45 toxic ones to learn from at the smaller size."""
    folder = f"/root/testdata/sf{size}"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = toxicity.score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.toxic is not None]
    accuracy = np.mean([r.predicted == r.toxic for r in held])
    caught = np.mean([r.predicted for r in held if r.toxic])
    print(size, len(held), accuracy, caught)
    assert accuracy >= 0.9 and caught >= 0.5


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """Thresholds count every labelled document, and parts beyond the first rows teach words that those lack."""
    from tests.llm.conftest import documents, words

    monkeypatch.setattr(toxicity, "FIRST_ROWS", 400)
    monkeypatch.setattr(toxicity, "PART_ROWS", 600)
    seen = []
    plain = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda *a: seen.append(a) or plain(*a))
    rows = []
    for k in range(2500):
        body = words(k, 30)
        if k % 8 == 0:
            body[k % 30] = "vile" if k % 16 else "nasty"
        rows.append((k, " ".join(["the", "of", *body]), "en", "s"))
    labels = spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(2500)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(documents(spark, rows), labels).collect()
    learnt = [k for k in range(2500) if remainder(k, 5)]
    _, label, _, weight = seen[0]
    assert weight.sum() == len(learnt) and weight[label == 1].sum() == sum(k % 8 == 0 for k in learnt)
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in got if r.held_out]) > 0.97


def test_thresholds_by_language():
    logit = np.array([-3.0, -2, -1, 0, 1, 2, 3, 4])
    label = np.array([0, 0, 1, 1, 0, 0, 1, 1])
    lang = np.array([0, 0, 0, 0, 1, 1, 1, 1])
    out = toxicity.calibrate(np.tile(logit, 200), np.tile(label, 200), np.tile(lang, 200))
    assert -2 < out[0] < -1 and 2 < out[1] < 3


def test_toxicity_odd_rows(spark, odd, odd_rows, none, labels):
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(none, labels).collect() == []
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}


# ------------------------------------------------------------------ language
def test_gradients_of_the_network(monkeypatch):
    monkeypatch.setattr(bytegru, "LENGTH", 7)
    rng = np.random.default_rng(3)
    net = bytegru.ByteNetwork(3)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    cells = rng.integers(97, 101, (7, 5)).astype(np.uint8)
    length, label = np.array([7, 7, 5, 1, 6]), np.array([0, 1, 2, 0, 1])
    mine = (np.arange(7)[:, None] < length).astype(float)

    def loss():
        out = np.zeros((7, 5, 3))
        for way in ("fore", "back"):
            for t, *_, state in net._run(way, cells):
                out[t] += state @ net.params[way, "v"]
        out += net.params["bias"]
        logp = out - np.log(np.exp(out).sum(axis=2, keepdims=True))
        return -(logp[:, np.arange(5), label] * mine).sum() / mine.sum()

    grads = net._gradients(cells, length, label)
    for key, value in net.params.items():
        flat = value.reshape(-1)
        places = rng.choice(np.flatnonzero(np.abs(grads[key].reshape(-1)) > 1e-6), 5)
        for p in places:
            at = flat[p]
            flat[p] = at + 1e-6
            up = loss()
            flat[p] = at - 1e-6
            down = loss()
            flat[p] = at
            assert abs((up - down) / 2e-6 - grads[key].reshape(-1)[p]) < 2e-4, key


def test_pooling_is_the_mean_over_letters():
    net = bytegru.ByteNetwork(2)
    texts = ["ab1 c", "", "é", "x" * 200]
    data, ends = text_bytes(pa.array(texts))
    got = net.pooled(data, ends)
    assert np.allclose(got[[0, 2, 3]].sum(axis=1), 1, atol=1e-5) and (got[1] == 0).all()
    cells, length, owner = bytegru.sequences(data, ends)
    assert owner.tolist() == [0, 2, 3, 3, 3, 3] and length.tolist() == [5, 2, 64, 64, 64, 8]
    p = net.label(cells[:, :1])[:5, 0]
    assert np.allclose(got[0], p[[0, 1, 4]].mean(axis=0), atol=1e-6)


def test_language_held_out(spark):
    docs = table(spark, DATA, "documents")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if remainder(i, 4) == 2]
    assert all(got[i].held_out for i in held) and len(got) == len(truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97


def test_language_odd_rows(spark, odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(bytegru, "EPOCHS", 1)
    got = language.identify(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (4, 5, 6, 14, 15) or (r.doc_id is None and r.score == 0)) and 0 <= r.score <= 1
    assert language.identify(none).collect() == []
    blank = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in blank} == {"und"}


def test_letters():
    """Signs for numbers are no letters, in any script; modifier letters and ideographs are."""
    assert not any(language.has_letter(t) for t in ("", "½ ² ①", "12 Ⅷ _ !", "\u0301", "😀"))
    assert all(language.has_letter(t) for t in ("1a", "漢", "ʰ", "ª", "é"))


def test_language_sample(spark, monkeypatch):
    """At most SAMPLE documents of a language and SAMPLE_ALL in all, but one of every language."""
    rows = [(k, "a hot one", "aa", "s") for k in range(3000)] + [(5000 + k, "other", f"l{k}", "s") for k in range(300)]
    own = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows], "doc_id long, text string, lang string")
    per = {r.lang: r["count"] for r in language.drawn(own, 1).groupBy("lang").count().collect()}
    assert len(per) == 301 and per["aa"] == min(400, 80_000 // 301)
    assert sorted(map(str, language.drawn(own.repartition(3), 1).collect())) == sorted(map(str, language.drawn(own, 1).collect()))
    monkeypatch.setattr(language, "SAMPLE_ALL", 50)
    assert {r["count"] for r in language.drawn(own, 1).groupBy("lang").count().collect()} == {1}


@pytest.mark.parametrize("modulus,rest", [(3, 1), (4, 2), (5, 0)])
def test_held_out_rule(spark, modulus, rest):
    df = spark.range(200).select(F.col("id"), quality.held_out(F.col("id"), modulus, rest).alias("h"))
    assert all(r.h == (remainder(r.id, modulus) == rest) for r in df.collect())
