"""Toxicity: a convolutional classifier with a threshold for each language."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import slices, stored
from encore.llm.quality import held_out, labelled
from encore.llm.textcnn import FUNCTION_WORDS, STEM_BITS, TextCnn, languages, tokens

#: Labelled documents that the networks start from, about; where there are no more, these are all and the networks are done.
FIRST_ROWS = 4000
#: Beyond these: labelled documents and words that one task goes on with, about, and how often all are gone through.
PART_ROWS, PART_WORDS, ROUNDS = 16_000, 8_000_000, 2
#: Parts of the labelled documents: each is judged by a network that has learnt from the others, and those log odds set the thresholds.
FOLDS = 4
#: Toxic documents of a language below which its threshold stays near the common one.
STEADY = 40
#: Numbers of a network that are added up as one row; steps and bound of the log odds that are counted for the thresholds.
CHUNK, STEPS, BOUND = 4096, 256, 32


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A number for each word: the buckets of the word and of its beginning."""
    for batch in batches:
        for part in slices(batch):
            word, stem, before = tokens(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(word << STEM_BITS | stem))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "token"])


def _split(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return token >> STEM_BITS, token & ((1 << STEM_BITS) - 1)


def _texts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_split(np.asarray(t.values, np.int32)) for t in column]


def _best_threshold(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float | None:
    """The cut with the best harmonic mean of precision and recall (F1), midway between two documents; None without both classes."""
    if label.min(initial=1) == label.max(initial=0):
        return None
    order = np.argsort(logit, kind="stable")
    x, y, w = logit[order], label[order], weight[order]
    hit = np.append(np.cumsum((w * y)[::-1])[::-1], 0)
    called = np.append(np.cumsum(w[::-1])[::-1], 0)
    gain = 2 * hit / (hit[0] + called)
    # no cut between equal log odds
    gain[1:-1][x[1:] == x[:-1]] = 0
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    return float(edges[best[(len(best) - 1) // 2]])


def calibrate(logit: np.ndarray, label: np.ndarray, language: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Threshold on the log odds by language, drawn to the common one as a language has few toxic documents."""
    weight = np.ones(len(label)) if weight is None else weight
    common = _best_threshold(logit, label, weight)
    common = 0.0 if common is None else common
    out = np.full(len(FUNCTION_WORDS) + 1, common)
    for k in range(len(out)):
        own = language == k
        best = _best_threshold(logit[own], label[own], weight[own]) if own.any() else None
        if best is not None:
            toxic = (weight[own] * label[own]).sum()
            w = toxic / (toxic + STEADY)
            out[k] = w * best + (1 - w) * common
    return out


def _joined(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before = np.concatenate([[0], np.cumsum([len(w) for w, _ in texts])]).astype(np.int64)
    return np.concatenate([w for w, _ in texts]), np.concatenate([s for _, s in texts]), before


def dealt(label: np.ndarray, seed: int) -> np.ndarray:
    """Fold of each text: the rows come in the order of ids; a seeded order of their own deals them out, toxic ones evenly."""
    fold = np.empty(len(label), int)
    for c in (0, 1):
        own = np.flatnonzero(label == c)
        fold[own] = np.random.default_rng(seed + c).permutation(len(own)) % FOLDS
    return fold


def _start(seed: int, whole: bool):
    """Network number ``model`` of the rows of a group: without that fold, or (FOLDS) of all folds; log odds of the fold left out.

    ``whole``: the group holds all labelled rows, and folds are dealt in it.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("draw", "ascending")])
        k, label, texts = table["model"][0].as_py(), table["label"].to_numpy().astype(int), _texts(table["token"])
        mine = (dealt(label, seed) if whole else table["fold"].to_numpy()) == k
        model, square = TextCnn(), None
        if not mine.all():
            square = model.train([t for t, m in zip(texts, mine, strict=True) if not m], label[~mine])
        own = [t for t, m in zip(texts, mine, strict=True) if m] if whole else []
        logit, lang = np.zeros(len(own)), np.zeros(len(own), int)
        if own:
            word, stem, before = _joined(own)
            lang = languages(word, before)
            logit = logit if square is None else model.logits(word, stem, before)
        judged = pickle.dumps((logit, label[mine] if whole else label[:0], lang))
        return pa.table({"model": pa.array([k], pa.int32()), "state": pa.array([pickle.dumps((model.flat(), square))], pa.binary()), "judged": pa.array([judged], pa.binary())})

    return run


def _go_on(shared, share: float):
    """What each network changes by an epoch over the rows of a group, in chunks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("draw", "ascending")])
        label, fold, texts = table["label"].to_numpy().astype(int), table["fold"].to_numpy(), _texts(table["token"])
        out = []
        for k, (flat, square) in enumerate(map(pickle.loads, shared.value)):
            kept = np.flatnonzero(fold != k)
            if not len(kept):
                continue
            model = TextCnn()
            model.load(flat)
            model.train([texts[i] for i in kept], label[kept], 1, square, share)
            change = model.flat() - flat
            out += [(k, c, change[at : at + CHUNK]) for c, at in enumerate(range(0, len(change), CHUNK)) if change[at : at + CHUNK].any()]
        return pa.table(
            {"model": pa.array([k for k, _, _ in out], pa.int32()), "chunk": pa.array([c for _, c, _ in out], pa.int32()), "change": pa.array([x for _, _, x in out], pa.list_(pa.float32()))}
        )

    return run


def _mean(table: pa.Table) -> pa.Table:
    """The mean change of each number over the parts that have changed it: a rare word's is not thinned by parts without it."""
    change = np.sort(np.stack([np.asarray(x.values) for x in table["change"]]), axis=0)
    mean = change.sum(axis=0, dtype=np.float64) / np.maximum(1, (change != 0).sum(axis=0))
    return pa.table({"model": table["model"][:1], "chunk": table["chunk"][:1], "change": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})


def _judge(shared):
    """Language, label and log odds (rounded to a step) of each row, by the network that has not seen its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = []
        for flat, _ in map(pickle.loads, shared.value):
            models.append(TextCnn())
            models[-1].load(flat)
        tables = [m.tables() for m in models]
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for k in range(FOLDS):
                part = batch.filter(pa.array(fold == k))
                if part.num_rows:
                    word, stem, before = _joined(_texts(part.column("token")))
                    logit = np.clip(models[k].logits(word, stem, before, tables[k]), -BOUND, BOUND)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(languages(word, before).astype(np.int32)), part.column("label"), pa.array(np.round(logit * STEPS).astype(np.int32))], names=["lang", "label", "step"]
                    )

    return run


def fit(docs: DataFrame, labels: DataFrame, seed: int = 3) -> tuple[TextCnn, np.ndarray] | None:
    """Classifier and thresholds from all labelled documents; None without both classes.

    Tasks train the networks, one for each fold left out and one for all folds. They start from about FIRST_ROWS documents; if there
    are more, every part of all labelled documents goes on from there in a task of its own, and the changes are averaged, in ROUNDS rounds. Every labelled document is
    then judged by the network that has not seen it, and counts by language, label and steps of log odds set the
    thresholds. The driver holds FOLDS + 1 networks and those counts, whatever the number of documents.
    """
    draw = F.xxhash64(F.lit(seed), "doc_id", "token")
    rows = docs.mapInArrow(_tokens, "doc_id long, token array<int>").join(labels.hint("merge"), "doc_id")
    rows = stored(rows.select("doc_id", "label", "token", draw.alias("draw"), F.pmod(draw, F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-labelled")
    n, toxic, words = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(F.size("token")), F.lit(0))).first()
    if toxic in (0, n):
        return None
    whole = n <= FIRST_ROWS
    first = rows if whole else rows.filter(F.pmod(F.shiftright("draw", 8), F.lit(1 << 32)) < int(FIRST_ROWS / n * (1 << 32)))
    each = first.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    started = each.groupBy("model").applyInArrow(_start(seed, whole), "model int, state binary, judged binary").collect()
    # repeated rows are drawn alike: there may be no first ones
    states = [pickle.dumps((TextCnn().flat(), None))] * (FOLDS + 1)
    for r in started:
        states[r.model] = r.state
    sc = docs.sparkSession.sparkContext
    if whole:
        logit, label, lang = (np.concatenate(x) for x in zip(*[pickle.loads(r.judged) for r in sorted(started, key=lambda r: r.model)], strict=True))
        weight = None
    else:
        parts = max(-(-n // PART_ROWS), -(-words // PART_WORDS))
        dealt_rows = rows.withColumn("part", F.pmod(F.shiftright("draw", 20), F.lit(parts)))
        for _ in range(ROUNDS):
            shared = sc.broadcast(states)
            changes = dealt_rows.groupBy("part").applyInArrow(_go_on(shared, toxic / n), "model int, chunk int, change array<float>")
            mean = changes.groupBy("model", "chunk").applyInArrow(_mean, "model int, chunk int, change array<float>").toArrow()
            shared.destroy()
            own = [pickle.loads(s) for s in states]
            for k, c, x in zip(mean["model"].to_pylist(), mean["chunk"].to_pylist(), mean["change"], strict=True):
                own[k][0][c * CHUNK : (c + 1) * CHUNK] += np.asarray(x.values)
            states = [pickle.dumps(s) for s in own]
        shared = sc.broadcast(states)
        counts = rows.select("token", "label", "fold").mapInArrow(_judge(shared), "lang int, label int, step int").groupBy("lang", "label", "step").count().toArrow()
        shared.destroy()
        lang, label, weight = (counts[c].to_numpy() for c in ("lang", "label", "count"))
        logit = counts["step"].to_numpy() / STEPS
    model = TextCnn()
    model.load(pickle.loads(states[FOLDS])[0])
    return model, calibrate(logit, label, lang, weight)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Probability that each document is toxic.

    Hashed embeddings of words and of their beginnings, filters over 1, 2 and 3 words, max pooling over the whole
    text and a logistic layer, trained in numpy by tasks on all labelled documents outside the
    held-out fifth. Networks trained on three quarters of these judge the rest, and those log odds set a
    threshold for each language (told from the text's function words) at the best F1; scores are shifted so that 0.5
    is the threshold.

    Returns doc_id, held_out, score, predicted. Null and empty texts are scored as texts without
    words; a null doc_id is neither held out nor learnt from; without labels of both kinds the
    score is 0; repeated rows are scored each. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    fitted = fit(rows, labelled(labels, "toxic", 5, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = fitted[0].tables() if fitted else None
        for batch in batches:
            for part in slices(batch):
                if fitted:
                    word, stem, before = tokens(part.column("text"))
                    logit = fitted[0].logits(word, stem, before, tables) - fitted[1][languages(word, before)]
                    score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                else:
                    score = np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
