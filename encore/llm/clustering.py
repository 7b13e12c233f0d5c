"""Centroid clustering over whole numbers, with dot products kept between rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import removed, stored, stored_at
from encore.llm.vectors import lists, matrix, of_length

#: Components of a vector, centroids, rounds, the factor before rounding down, and the seed of the first centroids.
LENGTH, CENTROIDS, ROUNDS, FACTOR, SEED = 64, 40, 5, 256, 2
#: Components beyond this could make a squared distance that is no long.
LARGEST = 1 << 27


def _vectors(length: int, factor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = of_length(batch.column("vector"), factor, length)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"a component times {factor} is beyond 2^27")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), lists(x.astype(np.int32))], names=["vec_id", "x"])

    return run


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray, change: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, their dot products with ``centroids`` and their nearest ones.

    ``change`` is what each centroid has moved since the kept products: only its nonzero components
    are multiplied.
    """
    x = matrix(batch.column("x"), centroids.shape[1]).astype(np.int64)
    dots = np.zeros((len(x), len(centroids)), np.int64) if first else matrix(batch.column("dots"), len(centroids)).copy()
    for k, moved in enumerate(change):
        at = np.flatnonzero(moved)
        if len(at):
            dots[:, k] += x[:, at] @ moved[at]
    own = (centroids * centroids).sum(axis=1)
    return x, dots, (own - 2 * dots).argmin(axis=1)


def _moved(centroids: np.ndarray, change: np.ndarray, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, dots, cluster = _nearest(batch, centroids, change, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), lists(dots), pa.array(cluster.astype(np.int32))],
                names=["vec_id", "x", "dots", "cluster"],
            )

    return run


def _measured(centroids: np.ndarray, change: np.ndarray, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, dots, cluster = _nearest(batch, centroids, change, first)
            own = np.arange(len(x))
            distance = (x * x).sum(axis=1) - 2 * dots[own, cluster] + (centroids * centroids).sum(axis=1)[cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return run


def _first_centroids(vectors: DataFrame, count: int, seed: int, length: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").select(digest.alias("h"), "x").orderBy("h", "x").limit(count).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, length)


def cluster_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    length: int = LENGTH,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    factor: int = FACTOR,
    seed: int = SEED,
) -> DataFrame:
    """Clusters of vectors by the nearest of ``centroids`` centroids, all in whole numbers.

    Components become floor(factor * component). The centroids start as the vectors whose
    sha256 of ``seed:vec_id`` is smallest. Each vector's exact dot products with all centroids are
    kept in a table between rounds; a round adds to them, for each centroid, the vector's components
    where the centroid has moved times what it has moved there, and takes the smallest
    |c|^2 - 2 x.c (ties: the smaller number). Sums and counts a centroid are partial aggregates,
    of which centroids x (length + 1) numbers reach the driver; a centroid becomes floor(sum / count) of its
    vectors, or stays where it has none. Rounds end early only when no centroid moves, which
    changes nothing. A round's table replaces the last one's, so two stand at a time.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each
    vector with exactly ``length`` components, none null or non-finite; other rows are left out. Rows that repeat a
    vec_id are vectors each (as first centroids in the order of their components); a null vec_id is
    clustered but starts no centroid; with fewer vectors than centroids there are as many
    centroids as vectors with an id. An empty table, or one without any id, gives an empty result. Components beyond 2^27 / factor are an error: distances
    would exceed a long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    table, path = stored_at(kept.mapInArrow(_vectors(length, factor), "vec_id long, x array<int>"), "cluster-vectors")
    now = _first_centroids(table, centroids, seed, length)
    if not len(now):
        return table.limit(0).selectExpr(
            "vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"
        )
    change, first = now, True
    for _ in range(rounds):
        was = path
        table, path = stored_at(table.mapInArrow(_moved(now, change, first), "vec_id long, x array<int>, dots array<long>, cluster int"), "cluster-round")
        removed(spark, was)
        sums = table.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(k))) for k in range(length)]).alias("s")).collect()
        new = now.copy()
        for r in sums:
            new[r.cluster] = [s // r.n for s in r.s]
        change, now, first = new - now, new, False
        if not change.any():
            break
    out = stored(table.mapInArrow(_measured(now, change, first), "vec_id long, cluster int, distance long"), "cluster-out")
    removed(spark, path)
    inertia = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    named = [
        (k, s, total, hashlib.sha256(",".join(map(str, now[k].tolist())).encode()).hexdigest()) for k, s in sorted(inertia.items())
    ]
    return out.join(F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _oracle() -> str:
    """Rounds one by one: distances to all centroids, the least, and sums a centroid and component."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS (
  SELECT r, min(CAST(list_inner_product(v.y, v.y) - 2 * list_inner_product(v.y, c.y) + list_inner_product(c.y, c.y) AS BIGINT) * 64 + c.k) AS m
  FROM v CROSS JOIN c{k} c GROUP BY r)""")
        if k < ROUNDS:
            steps.append(f"""
s{k} AS (
  SELECT a.m % 64 AS k, u.d, sum(u.e) AS s, count(*) AS n
  FROM a{k} a JOIN (SELECT r, unnest(range(1, {LENGTH + 1})) AS d, unnest(x) AS e FROM v) u USING (r) GROUP BY 1, 2),
c{k + 1} AS (
  SELECT c.k, coalesce(g.y, c.y) AS y FROM c{k} c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) / n AS DOUBLE) ORDER BY d) AS y FROM s{k} GROUP BY k) g USING (k))""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, x, CAST(x AS DOUBLE[]) AS y FROM (
    SELECT vec_id, [CAST(floor({FACTOR} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings
    WHERE len(embedding) = {LENGTH} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {LENGTH})),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, y FROM (
    SELECT sha256('{SEED}:' || vec_id) AS h, x, y FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {CENTROIDS})),
{",".join(steps)},
o AS (SELECT v.vec_id, a.m % 64 AS k, a.m // 64 AS distance FROM a{ROUNDS} a JOIN v USING (r))
SELECT o.vec_id, CAST(o.k AS INTEGER) AS cluster, o.distance,
  CAST(sum(distance) OVER (PARTITION BY o.k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(CAST(e AS BIGINT) AS VARCHAR) FOR e IN c.y], ',')) AS centroid_sha256
FROM o JOIN c{ROUNDS} c USING (k)
"""


ORACLE_SQL = _oracle()
