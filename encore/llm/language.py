"""Language identification by a bidirectional recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.bytegru import LENGTH, ByteNetwork
from encore.llm.common import bucket, slices, stored, text_bytes
from encore.llm.quality import held_out

#: Documents to learn from, at most: of a language, and in all, so that many languages give fewer each (one at least).
SAMPLE, SAMPLE_ALL = 400, 80_000
#: Runs of bytes drawn from each document, and parts in which a language's documents are ranked first.
RUNS, PARTS = 8, 64
NONE = "und"


def has_letter(text: str) -> bool:
    """Whether any character is a letter; other signs for numbers are none."""
    return any(map(str.isalpha, text))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS evenly spread runs of LENGTH bytes of each text."""
    for batch in batches:
        for part in slices(batch):
            data, ends = text_bytes(part.column("text"))
            ids, langs, bodies = [], [], []
            for i, (doc_id, lang) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), strict=True)):
                last = max(ends[i], ends[i + 1] - LENGTH)
                for start in np.unique(np.linspace(ends[i], last, RUNS).astype(int)):
                    ids.append(doc_id)
                    langs.append(lang)
                    bodies.append(data[start : min(start + LENGTH, ends[i + 1])].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(bodies, pa.binary())], names=["doc_id", "lang", "run"])


def drawn(own: DataFrame, seed: int) -> DataFrame:
    """(doc_id, lang): the sample of each language, by a seeded hash.

    A language is ranked in PARTS parts first, so one that has most rows is not ranked in one task.
    """
    key = F.xxhash64(F.lit(seed), "doc_id")
    ids = own.select("doc_id", "lang").withColumn("part", bucket(PARTS, F.col("doc_id"))).withColumn("key", key)
    first = ids.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy("key", "doc_id"))).filter(F.col("k") <= SAMPLE)
    first = stored(first.select("doc_id", "lang", "key"), "language-drawn")
    each = max(1, min(SAMPLE, SAMPLE_ALL // max(1, first.select("lang").distinct().count())))
    k = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    return first.withColumn("k", k).filter(F.col("k") <= each).select("doc_id", "lang").distinct()


def fit(docs: DataFrame, seed: int = 9) -> tuple[ByteNetwork, list[str]] | None:
    """Network and its labels, from a bounded sample of each language; None without labels.

    The sample's ids are drawn per language before anything is shuffled, and broadcast (SAMPLE_ALL at most, or one a
    language), so texts are not shuffled; RUNS * LENGTH bytes of a text reach the driver.
    """
    own = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0) & ~held_out(F.col("doc_id"), 4, 2))
    chosen = drawn(own, seed)
    rows = own.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    sample = rows.mapInArrow(_runs, "doc_id long, lang string, run binary").toArrow().to_pylist()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["doc_id"], r["lang"], r["run"]))
    names = sorted({r["lang"] for r in sample})
    cells = np.zeros((LENGTH, len(sample)), np.uint8)
    length = np.array([len(r["run"]) for r in sample])
    for k, r in enumerate(sample):
        cells[: length[k], k] = np.frombuffer(r["run"], np.uint8)
    network = ByteNetwork(len(names))
    network.train(cells, length, np.array([names.index(r["lang"]) for r in sample]))
    return network, names


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Language of each whole text.

    Two gated recurrent layers read the bytes from either end, in runs of 64 bytes, and give every
    byte a probability of each language; a document's are the means over its letter bytes. The
    network is trained in numpy by backpropagation through time on at most 400 documents of each
    language (80,000 in all, one of each language at least) whose crc32 remainder is not held out. Every language of
    those can be predicted.

    Returns doc_id, held_out, lang_pred, score. Null texts and texts without a letter are `und`
    with score 0, as is everything when no row has a language; a null doc_id is neither held out nor learnt from; repeated
    rows are labelled each. Other columns are ignored.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    fitted = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, score = [NONE] * part.num_rows, np.zeros(part.num_rows)
                if fitted:
                    network, labels = fitted
                    pooled = network.pooled(*text_bytes(part.column("text")))
                    for i, body in enumerate(part.column("text")):
                        if body.is_valid and has_letter(body.as_py()):
                            best = int(pooled[i].argmax())
                            names[i], score[i] = labels[best], min(1.0, float(pooled[i, best]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
