"""Sharding: the flow against brute force, the law of the shards, the files."""

import itertools
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.llm import sharding
from encore.llm.transport import level_capacities, min_cost_transport
from tests.llm.conftest import documents, words


def cheapest(supply, capacity, cost):
    """Least cost by trying every flow of small whole amounts."""
    best = np.inf
    m, n = len(supply), len(capacity)
    rows = [[c for c in itertools.product(range(s + 1), repeat=n) if sum(c) == s] for s in supply]
    for flow in itertools.product(*rows):
        f = np.array(flow)
        if (f.sum(axis=0) <= capacity).all():
            best = min(best, float((f * cost).sum()))
    return best if m else 0.0


def test_flow_is_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(40):
        supply = rng.integers(0, 4, 3).tolist()
        capacity = rng.integers(1, 5, 3).tolist()
        cost = rng.integers(0, 6, (3, 3)).astype(float)
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError, match="capacities"):
                min_cost_transport(supply, capacity, cost)
            continue
        flow = min_cost_transport(supply, capacity, cost)
        assert flow.sum(axis=1).tolist() == supply and (flow.sum(axis=0) <= capacity).all() and (flow >= 0).all()
        assert float((flow * cost).sum()) == cheapest(supply, capacity, cost)


def test_level_capacities():
    assert level_capacities(10, [0, 0, 0]) in ([4, 3, 3], [3, 4, 3])
    assert level_capacities(6, [10, 0, 2]) == [0, 4, 2]
    assert level_capacities(0, [3, 1]) == [0, 0]
    assert sum(level_capacities(1001, [5, 900, 20], [1, 2, 1])) == 1001


def check(rows, got, n):
    assert len(got) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows
    )
    for k in range(n):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    return [sum(r.size for r in got if r.shard == k) for k in range(n)]


def test_near_equal_and_few_moves(spark):
    rows = [(k, " ".join(words(k, 1 + k % 40)), "en", f"s{0 if k % 3 == 0 else k % 9}") for k in range(3000)]
    df = documents(spark, rows, clash=True)
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(8)).cast("int")
    out = sharding.assign_shards(df, old, 8)
    got = out.collect()
    loads = check(rows, got, 8)
    mean = sum(loads) / 8
    assert max(abs(x - mean) for x in loads) < 0.02 * mean
    before = [sum(r.size for r in got if r.old_shard == k) for k in range(8)]
    least = sum(max(0, b - mean) for b in before)
    moved = sum(r.size for r in got if r.old_shard != r.shard)
    assert moved <= least * 1.05 + mean * 0.05
    again = sharding.assign_shards(df.repartition(5), old, 8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_odd_rows(spark, odd, odd_rows, none):
    got = sharding.shard_rows(odd).collect()
    check(odd_rows, got, 40)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_rows(none).collect() == []


def test_rewrite_touches_only_affected_shards(spark):
    rows = [(k, " ".join(words(k, 20)), "en", "s") for k in range(400)]
    df = documents(spark, rows)
    # shards 0 and 1 hold all that is uneven; 2 and 3 are full as they are
    old = F.when(F.col("doc_id") < 150, 0).when(F.col("doc_id") < 200, 1).otherwise(F.when(F.col("doc_id") < 300, 2).otherwise(3))
    weights = [r.b for r in df.groupBy(old.alias("o")).agg(F.sum(F.octet_length("text") + 16).alias("b")).orderBy("o").collect()]
    even = (weights[0] + weights[1]) / 2
    assigned = sharding.assign_shards(df, old, 4, capacities=[even, even, weights[2], weights[3]])
    path = tempfile.mkdtemp(prefix="encore-shards-") + "/new"
    affected = sharding.rewrite_shards(df, assigned, path)
    written = spark.read.parquet(path)
    want = {r.doc_id: r.shard for r in assigned.collect() if r.shard in affected}
    assert {r.doc_id: r.shard for r in written.collect()} == want and 0 in affected and 1 in affected


def test_rewrite_writes_every_row_once(spark):
    """Repeated and null doc_ids, whole copies, and a second run to the same folder."""
    rows = [(k // 2 if k % 7 else None, " ".join(words(k, 5 + k % 30)), "en", f"s{k % 3}") for k in range(300)]
    rows += [(5, "the same row", "en", f"s{k % 2}") for k in range(40)]
    df = documents(spark, rows, clash=True)
    old = F.pmod(F.crc32("source"), F.lit(4)).cast("int")
    assigned = sharding.assign_shards(df, old, 4)
    path = tempfile.mkdtemp(prefix="encore-shards-") + "/new"
    affected = sharding.rewrite_shards(df, assigned, path)
    assert sharding.rewrite_shards(df, assigned, path) == affected
    where = assigned.collect()
    written = spark.read.parquet(path).withColumn("old", old).collect()
    want = sorted((r.text_crc32, r.size, r.old_shard, r.shard, r.slot) for r in where if r.shard in affected)
    got = sorted((zlib.crc32(r.text.encode()), len(r.text.encode()) + 16, r.old, r.shard, r._slot) for r in written)
    assert got == want
    # with the files that stay, all rows are there
    stay = [str((i, t, s)) for i, t, _, s in rows]
    kept = [str((r.doc_id, r.text, r.source)) for r in df.withColumn("old", old).collect() if r.old not in affected]
    assert sorted(kept + [str((r.doc_id, r.text, r.source)) for r in written]) == sorted(stay)


def test_query_rewrites(spark, monkeypatch):
    """The query's rows of affected shards are those of the files."""
    seen = []
    rewrite = sharding.rewrite_shards
    monkeypatch.setattr(sharding, "rewrite_shards", lambda docs, assigned, path: seen.append((path, rewrite(docs, assigned, path))) or seen[-1][1])
    rows = [(k // 2, " ".join(words(k // 2, 20)), "en", f"s{k % 3}") for k in range(200)]
    got = sharding.shard_rows(documents(spark, rows), 4).collect()
    check(rows, got, 4)
    (path, affected), = seen
    assert affected and spark.read.parquet(path).count() == sum(r.shard in affected for r in got)


def test_capacities_hold_with_long_documents(spark):
    """Documents too long for the flow fill each shard up to its own capacity, but for one document."""
    weights = [1, 3, 2, 0.5]
    for longest in (40, 400):
        rows = [(k, " ".join(words(k, longest // 2 + k % (longest // 2))), "en", "s") for k in range(200)]
        rows += [(1000 + k, " ".join(words(k, 3)), "en", "s") for k in range(100)]
        df = documents(spark, rows)
        for old in (F.lit(3), F.pmod(F.col("doc_id"), F.lit(4))):
            got = sharding.assign_shards(df, old, 4, capacities=weights).collect()
            loads = check(rows, got, 4)
            levels = [sum(loads) * w / sum(weights) for w in weights]
            most = max(r.size for r in got)
            assert all(abs(x - y) <= most for x, y in zip(loads, levels, strict=True)), (loads, levels)
            # nothing moves out of a shard that stands below its capacity
            before = [sum(r.size for r in got if r.old_shard == k) for k in range(4)]
            moved = sum(r.size for r in got if r.old_shard != r.shard)
            assert moved <= sum(max(0, b - y) for b, y in zip(before, levels, strict=True)) + 4 * most
