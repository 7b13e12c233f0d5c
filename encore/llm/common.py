"""Helpers shared by the corpus operators: scratch tables, blocked running sums, byte slices."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.session import scratch_path, ship_package

#: A word: a maximal run of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one block of a blocked sum or numbering holds on average.
BLOCK_ROWS = 5_000

#: Bytes of text that a Python worker handles at a time: its arrays of words and positions take many times that.
SLICE_BYTES = 512 << 10
#: Bytes of the batches that Spark and a Python worker pass to each other, unless the session names others.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound batches by bytes: a batch of the default 10,000 texts takes tens of MB, several times over, on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    small_batches(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below spark.checkpoint.dir and read it back: lineage ends there."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stored, with the folder."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that stored_at has written; nothing may read it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_mark(df: DataFrame) -> Column:
    """Hash of all columns that have one: rows that agree in it stand in for each other. Never null."""
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind not in ("void", "variant")]
    return F.xxhash64(*plain, *[c.isNull() for c in plain])


def bucket(buckets: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(max(1, buckets)).cast("long")).cast("int")


def blocks_for(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS))


def running_start(df: DataFrame, group: list[str], block: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come before, by (block, order).

    A group may hold a third of all rows: only one block of it is sorted in one task, and the
    blocks meet as one sum each. Groups and blocks must not be null.
    """
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("_block_sum"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, block, F.coalesce(F.sum("_block_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        part.join(offsets, [*group, block])
        .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_offset", "_inside")
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text (one row at least)."""
    _, ends = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
        to = min(batch.num_rows, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to
