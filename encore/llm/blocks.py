"""Two-sided comparison inside groups, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import bucket, running_start, stored

#: Weight of the rows that one side of a block holds, about.
BLOCK_WEIGHT = 500_000

Compare = Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch]


def compare_blocks(left: DataFrame, right: DataFrame, payload: DataFrame, group: str, weight: str, compare: Compare, schema: str) -> DataFrame:
    """``compare`` on every block of left rows with every block of right rows of the same group.

    Both sides have the same few columns, among them ``group``, ``node`` and ``weight`` (not null);
    ``payload`` (node, items) is joined to them when the blocks are dealt out. A group is cut into
    blocks of BLOCK_WEIGHT, and a row goes to as many blocks as the other side has, so a hot group
    is spread over tasks and a task holds two blocks at a time. Only what ``compare`` returns goes
    on.
    """
    sides = []
    for side, rows in enumerate((left, right)):
        rows = stored(rows.withColumn("_bucket", bucket(64, F.col("node"))), "blocks-rows")
        cut = running_start(rows, [group], "_bucket", ["node"], weight, "_start")
        cut = cut.withColumn("_block", F.floor(F.col("_start") / BLOCK_WEIGHT).cast("int")).drop("_bucket", "_start", weight)
        sides.append(stored(cut.withColumn("_side", F.lit(side)), "blocks-cut"))
    parts = []
    for mine, other, names in ((sides[0], sides[1], ("_l", "_r")), (sides[1], sides[0], ("_r", "_l"))):
        blocks = other.groupBy(F.col(group).alias("_group")).agg(F.max("_block").alias("_blocks"))
        met = mine.join(blocks, F.col(group) == F.col("_group")).withColumnRenamed("_block", names[0])
        parts.append(met.withColumn(names[1], F.explode(F.sequence(F.lit(0), "_blocks"))).drop("_group", "_blocks"))
    met = stored(parts[0].unionByName(parts[1]), "blocks-met").join(payload.hint("merge"), "node")
    key = [group, "_l", "_r"]
    dealt = met.repartition(*key).sortWithinPartitions(*key, "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(np.searchsorted(whole.column("_side").to_numpy(), 1))
                if 0 < cut < whole.num_rows:
                    found = compare(whole.slice(0, cut), whole.slice(cut))
                    if found.num_rows:
                        yield found

        for batch in batches:
            columns = np.stack([batch.column(k).to_numpy() for k in key])
            edges = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                mine = tuple(columns[:, lo])
                if mine != at:
                    yield from done()
                    held, at = [], mine
                held.append(batch.slice(lo, hi - lo))
        yield from done()

    return dealt.mapInArrow(run, schema)
