"""The pipeline's stages, each on what the one before kept, against what each operator says."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from encore.llm import cgk, minhash, mixing, quality
from encore.llm.common import stored, table
from encore.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in QUERIES and set(ORACLE_SQL) == {"op8_line_dedup", "op11_clustering", "op13_topk"}
    assert {q.split("_")[0] for q in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DATA), f"test-{name}")
        steps[name] = before, docs
        if name != "sharding":
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = steps["quality"]
    scores = quality.score_quality(before, table(spark, DATA, "labels"))
    assert ids(after) == ids(scores.filter("predicted = 1"))
    before, after = steps["near_duplicates"]
    assert ids(after) == ids(minhash.near_duplicates(before).filter("kept"))
    before, after = steps["decontamination"]
    assert ids(after) == ids(cgk.contamination(before, table(spark, DATA, "benchmark")).filter("not contaminated"))
    before, after = steps["mixing"]
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(before).collect() if r.taken}
    assert ids(after) == sorted(i for i, n in taken.items() for _ in range(n))
    before, after = steps["sharding"]
    assert ids(after) == ids(before)


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, repeated rows, long and empty texts, and columns that are called as those the stages use inside."""
    inside = ["_node", "_kept", "_row", "_several", "_first", "_id", "_mark", "_p", "_taken", "_k", "_copy", "_to", "_slot", "_old_shard"]
    for docs in (odd, none):
        for c in inside:
            docs = docs.withColumn(c, F.lit("mine"))
        rows = docs.count()
        # the given labels know the odd rows' doc_ids; the quality stage may drop any of them
        first = stored(corpus_pipeline.keep_quality(spark, docs, DATA), "odd-quality")
        assert first.columns == docs.columns and first.count() <= rows
        for name, stage in corpus_pipeline.STAGES[1:]:
            before, docs = docs, stored(stage(spark, docs, DATA), f"odd-{name}")
            if name == "sharding":
                assert docs.count() == before.count()
            else:
                assert docs.columns == before.columns
                assert all(r[c] == "mine" for r in docs.select(*inside).distinct().collect() for c in inside)
            assert (docs.count() > 0) == (rows > 0)


def test_entry_without_the_subpackage(tmp_path):
    """The entry point, and the rest of the library, do without the corpus operators."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.symlink(os.path.join(root, "__spark_entry__.py"), tmp_path / "entry_link.py")
    for name in ("encore",):
        os.makedirs(tmp_path / name)
        for item in os.listdir(os.path.join(root, name)):
            if item != "llm":
                os.symlink(os.path.join(root, name, item), tmp_path / name / item)
    text = (tmp_path / "entry_link.py").read_text()
    (tmp_path / "__spark_entry__.py").write_text(text)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """Neither what a Python worker is sent nor what it handles at a time grows with the length of the texts."""
    import pyarrow as pa

    from encore.llm import common

    docs = common.stored(spark.range(0, 6000, 1, 1).withColumn("text", F.repeat(F.lit("ten bytes "), 300)), "batches")

    def run(batches):
        for batch in batches:
            parts = [p.nbytes for p in common.slices(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes]), pa.array([max(parts)])], names=["n", "sent", "part"])

    got = docs.mapInArrow(run, "n long, sent long, part long").collect()
    assert sum(r.n for r in got) == 6000
    assert max(r.sent for r in got) < common.BATCH_BYTES + 10_000 and max(r.part for r in got) < (1 << 20)
