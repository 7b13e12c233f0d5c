"""Exact top-k search by inner product, a term (component) at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import bucket, scratch_path, stored
from encore.llm.vectors import lists_of, scaled

#: Factor before rounding down, results a query, and the divisor of the query ids.
FACTOR, TOP, EVERY = 64, 20, 20
#: Queries of one pass over the candidates; queries and candidates whose scores a task holds at a time.
QUERY_BLOCK, QUERY_SLICE, ROW_SLICE = 4096, 64, 1024

#: Who has a term, and with what weight; without owners everyone does, some with weight 0.
Posting = tuple[np.ndarray | None, np.ndarray]


class Queries:
    """A block of sparse query rows, cut into slices, each by term."""

    def __init__(self, numbers: np.ndarray, lengths: np.ndarray, values: np.ndarray):
        self.numbers = numbers
        self.largest = int(np.abs(values).max(initial=0))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self.slices = []
        for lo in range(0, len(lengths), QUERY_SLICE):
            hi = min(lo + QUERY_SLICE, len(lengths))
            self.slices.append((lo, hi, postings(lengths[lo:hi], values[ends[lo] : ends[hi]])))

    def terms(self, kind: type) -> list[tuple[int, int, dict[int, Posting]]]:
        return [(lo, hi, {t: (own, w.astype(kind)) for t, (own, w) in terms.items()}) for lo, hi, terms in self.slices]


def places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def postings(lengths: np.ndarray, values: np.ndarray) -> dict[int, Posting]:
    """For each term, those of the rows that have it and their weights; as one weight a row where most have it."""
    some = values != 0
    owner, term = np.repeat(np.arange(len(lengths)), lengths)[some], places(lengths)[some]
    order = np.argsort(term, kind="stable")
    terms, at = np.unique(term[order], return_index=True)
    owner, weight = owner[order], values[some][order]
    out: dict[int, Posting] = {}
    for t, a, b in zip(terms.tolist(), at, np.append(at, len(order))[1:], strict=True):
        if 2 * (b - a) > len(lengths):
            dense = np.zeros(len(lengths), np.int64)
            dense[owner[a:b]] = weight[a:b]
            out[t] = None, dense
        else:
            out[t] = owner[a:b], weight[a:b]
    return out


def accumulate(queries: dict[int, Posting], rows: dict[int, Posting], scores: np.ndarray, room: np.ndarray) -> None:
    """Add to ``scores`` (queries by candidates), a term at a time, the products of the weights of a term that both have."""
    for t, (of, weights) in queries.items():
        if t not in rows:
            continue
        at, own = rows[t]
        if of is None and at is None:
            scores += np.multiply(weights[:, None], own[None, :], out=room)
        elif of is None:
            scores[:, at] += weights[:, None] * own[None, :]
        elif at is None:
            scores[of] += weights[:, None] * own[None, :]
        else:
            scores[of[:, None], at[None, :]] += weights[:, None] * own[None, :]


class Best:
    """The best rows of each query so far: score, whether the row has no id (or there is no row: 2), id."""

    def __init__(self, queries: int, keep: int):
        self.keep = keep
        self.score = np.full((queries, keep), -(2**62), np.int64)
        self.kind = np.full((queries, keep), 2, np.int8)
        self.id = np.zeros((queries, keep), np.int64)

    def add(self, lo: int, hi: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """Scores (queries lo..hi by candidates) of candidates in the order of their ids."""
        n = scores.shape[1]
        # the order of ids within the key settles ties, so that a plain partition selects exactly
        kind = np.int32 if scores.dtype == np.int16 else np.int64
        key = scores.astype(kind) * kind(n) + np.arange(n - 1, -1, -1, dtype=kind)
        few = min(self.keep, n)
        at = np.argpartition(key, n - few, axis=1)[:, n - few :]
        score = np.concatenate([self.score[lo:hi], np.take_along_axis(scores, at, axis=1).astype(np.int64)], axis=1)
        kind = np.concatenate([self.kind[lo:hi], no_id[at]], axis=1)
        own = np.concatenate([self.id[lo:hi], ids[at]], axis=1)
        order = np.lexsort(np.stack([own, kind, -score]), axis=1)[:, : self.keep]
        for name, value in (("score", score), ("kind", kind), ("id", own)):
            getattr(self, name)[lo:hi] = np.take_along_axis(value, order, axis=1)


def _kind(bound: int) -> type:
    """The narrowest whole numbers that hold sums up to ``bound``, and keys of them."""
    if bound * ROW_SLICE >= 1 << 62:
        raise ValueError("an inner product may exceed a long")
    return np.int16 if bound < 1 << 15 else np.int32 if bound < 1 << 31 else np.int64


def _best_rows(shared, top: int, factor: int):
    """A task's best ``top`` + 1 candidates of every query of the block, the query's own row among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = Best(len(queries.numbers), top + 1)
        held: dict[type, list] = {}
        for batch in batches:
            rows, lengths, values = scaled(batch.column("vector"), factor)
            ids = batch.column("vec_id").take(pa.array(rows))
            no_id = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8)
            ids = ids.fill_null(0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)])
            kind = _kind(int(lengths.max(initial=0)) * int(np.abs(values).max(initial=0)) * queries.largest)
            if kind not in held:
                held[kind] = queries.terms(kind)
            order = np.lexsort((ids, no_id))
            for at in range(0, len(order), ROW_SLICE):
                own = order[at : at + ROW_SLICE]
                n = lengths[own]
                found = postings(n, values[np.repeat(ends[own], n) + places(n)])
                found = {t: (o, w.astype(kind)) for t, (o, w) in found.items()}
                for lo, hi, terms in held[kind]:
                    scores = np.zeros((hi - lo, len(own)), kind)
                    accumulate(terms, found, scores, np.empty_like(scores))
                    best.add(lo, hi, scores, ids[own], no_id[own])
        for lo in range(0, len(queries.numbers), 512):
            part = slice(lo, lo + 512)
            there = best.kind[part] < 2
            number = np.broadcast_to(queries.numbers[part, None], there.shape)[there]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array(best.id[part][there], mask=best.kind[part][there] == 1), pa.array(best.score[part][there])],
                names=["q", "vec_id", "score"],
            )

    return run


def _query_rows(factor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, values = scaled(batch.column("vector"), factor)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            squares = np.concatenate([[0], np.cumsum(values * values)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array(squares[ends[1:]] - squares[ends[:-1]]), lists_of(values, ends)],
                names=["query_id", "own", "x"],
            )

    return run


def top_rows(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = EVERY, top: int = TOP, factor: int = FACTOR
) -> DataFrame:
    """The ``top`` rows with the highest inner product with each query row, ties to the smaller vec_id.

    Components become floor(factor * component); queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows but the query's own. Queries are taken in blocks of QUERY_BLOCK
    sparse rows; a block is broadcast and one pass over the candidates answers it: a task turns
    each run of ROW_SLICE candidates into postings (term, rows, weights), adds the weighted
    postings of each query's nonzero terms into a dense array of scores, selects the best by
    partition, and merges them with its best so far. What leaves a task is ``top`` + 1 rows a query, whatever it has
    read; these meet by query, and a pass's result is written before the next begins. Every score is computed; memory follows the
    blocks, not the table.

    Returns query_id, rank (from 1), vec_id, score. Null vectors and those with null or non-finite components take no part;
    vectors of unlike lengths are multiplied where both have components. Rows that repeat a vec_id are rows
    each: a query leaves out itself, not its twin, and repeated queries are answered each. A null vec_id is a candidate, last among ties, and no
    query. An empty table, or one without queries, gives an empty result; a single row none. Scores that might exceed a long are an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    asked = rows.filter(F.col("vec_id") % every == 0).mapInArrow(_query_rows(factor), "query_id long, own long, x array<long>")
    # a number for each query row, kept in a table: repeated ids are queries of their own
    queries = stored(asked.withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    folder = scratch_path(spark, "llm", f"topk-{uuid.uuid4().hex}")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    for b in range(blocks):
        block = queries.filter(bucket(blocks, F.col("q")) == b)
        held = block.select("q", "x").toArrow().combine_chunks()
        x = held.column("x").combine_chunks()
        shared = spark.sparkContext.broadcast(Queries(held.column("q").to_numpy(), np.diff(x.offsets.to_numpy()), x.flatten().to_numpy()))
        found = rows.mapInArrow(_best_rows(shared, top, factor), "q long, vec_id long, score long")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top + 1)
        # the query's own row, or a row like it, is one of the best or is beaten by ``top`` others
        best = best.join(block.select("q", "query_id", "own"), "q")
        best = best.withColumn("self", F.min(F.when(mine, F.col("rank"))).over(Window.partitionBy("q")))
        best = best.filter(F.col("self").isNull() | (F.col("rank") != F.col("self")))
        best = best.withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("self"), 1).otherwise(0)).filter(F.col("rank") <= top)
        best.select("query_id", "rank", "vec_id", "score").write.parquet(f"{folder}/block={b}")
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*[f"{folder}/block={b}" for b in range(blocks)])


ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor({FACTOR} * CAST(e AS DOUBLE)) FOR e IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= {TOP}
"""
