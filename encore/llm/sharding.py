"""Sharding by minimum-cost flow: even shards with the fewest bytes moved."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import blocks_for, bucket, free_names, row_mark, running_start, stored
from encore.llm.transport import level_capacities, min_cost_transport
from encore.session import scratch_path

#: Documents above 1/LARGE of a shard are placed one by one; there are at most LARGE per shard.
LARGE = 256

#: Bytes that a document takes in a shard besides its text.
HEADER_BYTES = 16


def _place_large(sizes: list[tuple[int, int]], levels: list[float]) -> tuple[list[int], list[int]]:
    """Shard of each (size, old shard), largest first: the old one while it has room below its level, else the one with most room."""
    n_shards = len(levels)
    load, place = [0] * n_shards, [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k][0]):
        size, old = sizes[k]
        fits = 0 <= old < n_shards and load[old] + size <= levels[old]
        to = old if fits else min(range(n_shards), key=lambda j: load[j] - levels[j])
        place[k] = to
        load[to] += size
    return place, load


def assign_shards(
    docs: DataFrame,
    old_shard: Column,
    n_shards: int = 40,
    capacities: list[float] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """New shard of every row, near equal in bytes, moving as few bytes as that allows.

    Old shards supply bytes, new shards take up to their capacity (relative ``capacities``,
    equal by default); keeping a byte where it is costs 0, moving it 1, and the minimum-cost
    flow says how many bytes of each old shard go where. Spark then cuts each old shard, in
    blocks, into runs of those lengths. The driver sees one sum per shard and the documents
    above 1/256 of a mean shard (at most 256 a shard), which are placed as blocks of their own,
    each shard up to its own capacity.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, old_shard, shard, slot (gapless from 0
    in each shard), row_mark (hash of the row, by which rewrite_shards finds it again). Null text counts as empty, a null or unknown old shard as nowhere (its bytes
    move). Repeated rows are rows of their own and go where their position puts them. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body).cast("long") + HEADER_BYTES).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old_shard"),
            row_mark(docs).alias("row_mark"),
        ),
        "reshard-rows",
    )
    spark = docs.sparkSession
    rows, total = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = total / n_shards
    limit = int(mean // LARGE)
    large = narrow.filter(F.col("size") > limit).collect()
    large.sort(key=lambda r: (r.size, r.doc_id is None, r.doc_id or 0, r.text_crc32, r.old_shard, r.row_mark))
    # each shard's own share of all bytes
    weights = [1.0] * n_shards if capacities is None else list(capacities)
    levels = [total * w / sum(weights) for w in weights]
    place, load = _place_large([(r.size, r.old_shard) for r in large], levels)

    small = narrow.filter(F.col("size") <= limit)
    supply = {r.old_shard: r.b for r in small.groupBy("old_shard").agg(F.sum("size").alias("b")).collect()}
    olds = sorted(supply)
    rooms = level_capacities(sum(supply.values()), load, capacities)
    cost = np.array([[0.0 if i == j else 1.0 for j in range(n_shards)] for i in olds]).reshape(len(olds), n_shards)
    flow = min_cost_transport([supply[i] for i in olds], rooms, cost)
    runs = []
    for i, old in enumerate(olds):
        at = 0
        for j in range(n_shards):
            if flow[i, j]:
                runs.append((old, at, at + int(flow[i, j]), j))
                at += int(flow[i, j])

    schema = "old_shard int, lo long, hi long, shard int"
    blocks = blocks_for(rows)
    placed = running_start(
        small.withColumn("block", bucket(blocks, F.col("doc_id"), F.col("row_mark"))),
        ["old_shard"], "block", ["doc_id", "text_crc32", "size", "row_mark"], "size", "start",
    )
    middle = F.col("start") + F.floor(F.col("size") / 2)
    # at most one run per old and new shard: n_shards * (n_shards + 1) rows
    run = F.broadcast(spark.createDataFrame(runs, schema).withColumnRenamed("old_shard", "run_of"))
    placed = placed.join(run, (F.col("old_shard") == F.col("run_of")) & (middle >= F.col("lo")) & (middle < F.col("hi")))
    columns = ["doc_id", "size", "text_crc32", "old_shard", "row_mark", "shard", "block"]
    one_by_one = spark.createDataFrame(
        [(r.doc_id, r.size, r.text_crc32, r.old_shard, r.row_mark, to, -1) for r, to in zip(large, place, strict=True)],
        placed.select(*columns).schema,
    )
    whole = stored(placed.select(*columns).unionByName(one_by_one), "reshard-placed").withColumn("one", F.lit(1))
    whole = whole.withColumn("part", F.struct("old_shard", "block"))
    numbered = running_start(whole, ["shard"], "part", ["doc_id", "text_crc32", "size", "row_mark"], "one", "slot")
    return numbered.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot", "row_mark")


def affected_shards(assigned: DataFrame) -> list[int]:
    """Shards that lose or gain rows; all others keep their files as they are."""
    moved = assigned.filter(F.col("old_shard") != F.col("shard"))
    ends = moved.select(F.col("old_shard").alias("s")).union(moved.select(F.col("shard").alias("s")))
    return sorted(r.s for r in ends.filter("s >= 0").distinct().collect())


def place_columns(docs: DataFrame) -> list[str]:
    """The columns of the files that name a row's slot and its old shard: _slot and _old_shard, unless ``docs`` has such columns."""
    return free_names(docs, "_slot", "_old_shard")


def rewrite_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id") -> list[int]:
    """Write the files of the affected shards anew, one folder ``shard=K`` each, and return K's.

    ``docs`` are the rows given to assign_shards. They meet their shards by doc_id, row_mark and a copy number that
    both sides count alike, so each row is written once, also where rows repeat a doc_id or a whole row. The
    place_columns come with each row (a column shard of ``docs`` goes). Folders of affected shards that stand below ``path``
    are replaced, those left without rows go; shards not returned need no new file and keep theirs.
    """
    affected = affected_shards(assigned)
    slot, old = place_columns(docs)
    id_, mark, copy, to = free_names(docs, "_id", "_mark", "_copy", "_to")
    copies = Window.partitionBy(id_, mark)
    # copies of a row are alike on both sides but for where they go
    where = assigned.select(
        F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("row_mark").alias(mark), F.col("shard").alias(to),
        F.col("slot").alias(slot), F.col("old_shard").alias(old),
    ).withColumn(copy, F.row_number().over(copies.orderBy(to, slot)))
    where = where.filter(F.col(to).isin(affected))
    rows = docs.withColumn(mark, row_mark(docs)).withColumn(id_, F.coalesce(F.col(doc_id), F.lit(0))).drop("shard")
    rows = rows.withColumn(copy, F.row_number().over(copies.orderBy(mark)))
    rows = rows.join(where, [id_, mark, copy]).drop(id_, mark, copy).withColumnRenamed(to, "shard")
    # the numbering deals rows by id and mark already: the join takes that, else texts would be dealt out twice
    conf, every = docs.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(every)
    conf.set(every, "false")
    try:
        rows.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    finally:
        conf.set(every, before)
    filled = {r.shard for r in assigned.select("shard").distinct().collect()}
    jvm, hadoop = docs.sparkSession._jvm, docs.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for k in set(affected) - filled:
        folder = jvm.org.apache.hadoop.fs.Path(path, f"shard={k}")
        folder.getFileSystem(hadoop).delete(folder, True)
    return affected


def old_layout(column: str = "source", n_shards: int = 40) -> Column:
    """The layout before: files dealt by source, so that a hot source makes an overfull shard."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n_shards)).cast("int")


def shard_rows(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """The rows of the contract: law `bytes`, no grown shard.

    The affected shards are written anew to a fresh folder, and their rows are read from those files.
    """
    assigned = stored(assign_shards(docs, old_layout("source", n_shards), n_shards), "reshard-assigned")
    spark = docs.sparkSession
    path = scratch_path(spark, "llm", f"shards-{uuid.uuid4().hex}")
    affected = rewrite_shards(docs, assigned, path)
    body = F.coalesce("text", F.lit(""))
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", "old_shard"]
    slot, old = place_columns(docs)
    schema = f"doc_id long, text string, {slot} long, {old} int, shard int"
    written = spark.read.schema(schema).parquet(path).select(
        "doc_id", (F.octet_length(body).cast("long") + HEADER_BYTES).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        "shard", F.col(slot).alias("slot"), F.col(old).alias("old_shard"),
    )
    out = written.unionByName(assigned.filter(~F.col("shard").isin(affected)).select(*columns))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
