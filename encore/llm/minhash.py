"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.blocks import BLOCK_WEIGHT, compare_blocks
from encore.llm.common import free_names, row_mark, slices, stored, text_bytes
from encore.llm.components import components
from encore.llm.tokens import PLACE, mix64, shingles, split_words, word_hashes

#: Permutations, rows of a band, and low bits kept of each minimum.
PERMUTATIONS, ROWS, BITS = 128, 4, 4
BANDS = PERMUTATIONS // ROWS
SIGNATURE = PERMUTATIONS * BITS // 64
#: A pair goes on to the exact test when its estimate is at most this far below the threshold:
#: over four standard deviations of the estimate at the threshold.
MARGIN = 0.17

_FACTORS = np.random.default_rng(77).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, sig array<long>, bands array<long>"


def distinct_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and their numbers before each text."""
    data, ends = text_bytes(column)
    starts, stops, before = split_words(data, ends)
    runs, runs_before = shingles(word_hashes(data, starts, stops), before, size)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(runs_before))
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[new], np.searchsorted(owner[new], np.arange(len(ends)), "left")


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each permutation (multiplication by an odd factor)."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, np.multiply.outer(_FACTORS, hashes[at : at + 1024]).min(axis=1), out=least)
    return least


def signatures(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (rows of 64-bit words) and band keys of rows of minima."""
    low = (least >> np.uint64(32)) & np.uint64((1 << BITS) - 1)
    shift = (np.arange(PERMUTATIONS, dtype=np.uint64) % np.uint64(64 // BITS)) * np.uint64(BITS)
    packed = (low << shift).reshape(len(least), SIGNATURE, PERMUTATIONS // SIGNATURE).sum(axis=2, dtype=np.uint64)
    parts = least.reshape(len(least), BANDS, ROWS) * PLACE[100 : 100 + ROWS]
    return packed, mix64(parts.sum(axis=2, dtype=np.uint64) + PLACE[200 : 200 + BANDS])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets, before = distinct_sets(part.column("text"))
            n = np.diff(before)
            full = np.flatnonzero(n)
            least = np.empty((len(full), PERMUTATIONS), np.uint64)
            k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            for row, i in enumerate(full):
                own = sets[before[i] : before[i + 1]]
                least[row] = minima(own)
            if len(full):
                k1[full] = np.add.reduceat(mix64(sets ^ PLACE[300]), before[:-1][full])
                k2[full] = np.add.reduceat(mix64(sets + PLACE[301]), before[:-1][full])
            packed, bands = signatures(least)

            def lists(values, width, n=n, full=full):
                offsets = np.concatenate([[0], np.cumsum((n > 0) * width)]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).view(np.int64)))

            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                 lists(packed, SIGNATURE), lists(bands, BANDS)],
                names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets, before = distinct_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(sets.view(np.int64)))],
                names=["node", "items"],
            )


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal groups of bits, less those equal by chance."""
    ones = sum(1 << (BITS * k) for k in range(64 // BITS))
    ones = ones - 2**64 if ones >= 2**63 else ones
    unlike = F.lit(0)
    for k in range(SIGNATURE):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        unlike = unlike + F.bit_count(folded.bitwiseAND(F.lit(ones)))
    chance = 1.0 / 2**BITS
    return ((F.lit(1.0) - unlike / PERMUTATIONS) - chance) / (1 - chance)


def _full_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, items): the full sets of the rows of ``nodes`` (one column); reads all texts, keeps those."""
    ends = nodes.distinct().hint("merge")
    texts = docs.join(ends, docs.doc_id == ends[ends.columns[0]], "left_semi")
    return stored(texts.mapInArrow(_sets, "node long, items array<long>").filter(F.size("items") > 0), "minhash-sets")


def _alike(x: Column, y: Column, threshold: float) -> Column:
    """Whether two full sets are alike enough; unlike sizes tell before the sets are compared."""
    shared = F.size(F.array_intersect(x, y))
    near = F.least(F.size(x), F.size(y)) >= threshold * F.greatest(F.size(x), F.size(y))
    return near & (100 * shared >= F.lit(100 * threshold) * (F.size(x) + F.size(y) - shared))


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x")).hint("merge")
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y")).hint("merge")
    return pairs.join(x, "a").join(y, "b").filter(_alike(F.col("x"), F.col("y"), threshold)).select("a", "b").distinct()


def _near_nodes(least: float):
    """For compare_blocks, on signatures: the (lead, node, own, side) with a partner of another group at ``least`` or more."""
    chance = 1.0 / 2**BITS
    most_unlike = PERMUTATIONS * (1 - (least * (1 - chance) + chance))
    ones = np.uint64(sum(1 << (BITS * k) for k in range(64 // BITS)))

    def compare(left: pa.RecordBatch, right: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (s.column("items").flatten().to_numpy().view(np.uint64).reshape(s.num_rows, -1) for s in (left, right))
        own_x, own_y = left.column("own").to_numpy(), right.column("own").to_numpy()
        hit_x, hit_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for at in range(0, len(x), 64):
            unlike = np.zeros((len(x[at : at + 64]), len(y)), np.int16)
            for k in range(x.shape[1]):
                bits = x[at : at + 64, k, None] ^ y[None, :, k]
                folded = bits
                for s in range(1, BITS):
                    folded = folded | (bits >> np.uint64(s))
                unlike += np.bitwise_count(folded & ones)
            near = (unlike <= most_unlike) & (own_x[at : at + 64, None] != own_y[None, :])
            hit_x[at : at + 64] |= near.any(axis=1)
            hit_y |= near.any(axis=0)
        node = np.concatenate([left.column("node").to_numpy()[hit_x], right.column("node").to_numpy()[hit_y]])
        own = np.concatenate([own_x[hit_x], own_y[hit_y]])
        side = np.repeat(np.array([0, 1], np.int32), [hit_x.sum(), hit_y.sum()])
        lead = np.full(len(node), left.column("lead")[0].as_py(), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(lead), pa.array(node), pa.array(own), pa.array(side)], names=["lead", "node", "own", "side"])

    return compare


def _joining_links(threshold: float):
    """For compare_blocks, on full sets: of the linked pairs of different groups a spanning forest, by counting shared members.

    A link is given only where it joins two groups that the block's links before it have not joined, so a block gives fewer
    links than it has groups; the components are those of all links.
    """

    def compare(left: pa.RecordBatch, right: pa.RecordBatch) -> pa.RecordBatch:
        size = np.diff(right.column("items").offsets.to_numpy())
        items = right.column("items").flatten().to_numpy()
        owner = np.repeat(np.arange(right.num_rows), size)
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        node, mine_node = right.column("node").to_numpy(), left.column("node").to_numpy()
        # the group of each row; groups that a link joins take one number
        group = np.unique(np.concatenate([left.column("own").to_numpy(), right.column("own").to_numpy()]), return_inverse=True)[1]
        ours, theirs = group[: left.num_rows], group[left.num_rows :]
        a, b = [], []
        for i in range(left.num_rows):
            others = theirs != ours[i]
            if not others.any():
                continue
            mine = left.column("items")[i].values.to_numpy()
            lo, hi = np.searchsorted(items, mine, "left"), np.searchsorted(items, mine, "right")
            count = hi - lo
            where = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            shared = np.bincount(owner[where], minlength=right.num_rows)
            linked = np.flatnonzero((100 * shared >= 100 * threshold * (len(mine) + size - shared)) & others)
            joined, first = np.unique(theirs[linked], return_index=True)
            a += [mine_node[i]] * len(joined)
            b += node[linked[first]].tolist()
            group[np.isin(group, joined)] = ours[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def near_duplicates(docs: DataFrame, threshold: float = 0.75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose sets of 5-word shingles are linked by a similarity of ``threshold``.

    128 minima per document; their 4 low bits are packed into a 64-byte signature, their bands of
    4 propose pairs (a pair at 0.75 is missed 5 times in a million), the signatures' equal bits,
    corrected for chance, drop pairs far below the threshold, and full sets decide. Texts with
    equal sets are one node. First every member of a band's bucket is held against the bucket's
    smallest member and the groups are joined; then members outside that member's group are held
    against all of the group and against each other, in blocks, each of which gives a spanning forest of its links. So a bucket of
    copies costs one pair a member, and no two groups that a link joins stay apart. Hot buckets and groups are split by Spark's skew joins;
    joins of corpus size are merge joins at every size.

    Returns doc_id, n_shingles, component_id (smallest doc_id of the group), kept. Null, empty and
    word-less texts have 0 shingles and are linked with nothing; fewer than 5 words make one
    shingle. Rows that repeat a doc_id are one node with the links of each; each row is returned.
    A row with null doc_id is linked with nothing, kept, and has a null component_id. Other
    columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stored(rows.mapInArrow(_sign, _SIGNED), "minhash-signed")
    used = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(
        used.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("c"))
        .select("k1", "k2", "n_shingles", F.col("c.doc_id").alias("node"), F.col("c.sig").alias("sig"), F.col("c.bands").alias("bands")),
        "minhash-classes",
    )
    banded = classes.select("node", F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot < other")
    shared = stored(banded.join(pivots.select("band", "pivot"), "band"), "minhash-buckets")

    sig = classes.select("node", "sig")

    def signed_pairs(pairs: DataFrame) -> DataFrame:
        a = sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")).hint("merge")
        b = sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")).hint("merge")
        return pairs.join(a, "a").join(b, "b").filter(estimate(F.col("sa"), F.col("sb")) >= threshold - MARGIN).select("a", "b").distinct()

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("n")).union(pairs.select(F.col("b").alias("n")))

    first = shared.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(signed_pairs(first), "minhash-pairs")
    links = stored(_linked(first, _full_sets(ends(first), rows), threshold), "minhash-links")

    # members of another group than their bucket's pivot
    group = stored(components(links), "minhash-groups")
    grouped = shared.join(group.hint("merge"), "node", "left").select("node", "band", "pivot", F.coalesce("component", "node").alias("own"))
    lead = group.select(F.col("node").alias("pivot"), F.col("component").alias("lead")).hint("merge")
    grouped = grouped.join(lead, "pivot", "left").withColumn("lead", F.coalesce("lead", "pivot")).drop("pivot")
    apart = stored(grouped.filter("own <> lead"), "minhash-apart")
    # ... are held against the whole group of the pivot and against each other, first by signature, then by full set
    outside = stored(apart.select("lead", "node", "own").distinct(), "minhash-outside")
    crowd = outside.groupBy("lead").agg(F.count("*").alias("n")).join(
        group.groupBy(F.col("component").alias("lead")).agg(F.count("*").alias("m")).hint("merge"), "lead", "left"
    ).filter("n > 1 or m > 1").select("lead")
    left = stored(outside.join(crowd.hint("merge"), "lead", "left_semi").withColumn("weight", F.lit(BLOCK_WEIGHT // 4000)), "minhash-left")
    inside = group.select(F.col("component").alias("lead"), "node", F.col("component").alias("own"), F.lit(BLOCK_WEIGHT // 4000).alias("weight"))
    right = left.unionByName(inside.join(left.select("lead").distinct().hint("merge"), "lead", "left_semi"))
    near = compare_blocks(
        left, right, sig.withColumnRenamed("sig", "items"), "lead", "weight", _near_nodes(threshold - MARGIN),
        "lead long, node long, own long, side int",
    )
    size = classes.groupBy("node").agg(F.max("n_shingles").cast("int").alias("weight"))
    near = stored(near.distinct().join(size.hint("merge"), "node"), "minhash-near")
    more = compare_blocks(
        near.filter("side = 0").drop("side"), near.filter("side = 1").drop("side"), _full_sets(near.select("node"), rows),
        "lead", "weight", _joining_links(threshold), "a long, b long",
    )
    # a doc_id with rows in several classes ties these together
    key = F.struct("k1", "k2", "n_shingles")
    several = used.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo <> hi").select("doc_id")
    tied = used.join(several, "doc_id").join(classes.select("k1", "k2", "n_shingles", "node"), ["k1", "k2", "n_shingles"])
    links = links.union(stored(more, "minhash-more")).union(tied.select("doc_id", "node"))
    final = components(links)

    named = classes.select("k1", "k2", "n_shingles", "node").join(final, "node", "left")
    named = named.select("k1", "k2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = signed.join(named, ["k1", "k2", "n_shingles"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _named_rows(docs: DataFrame, node: str) -> DataFrame:
    """The rows with a doc_id, with a column ``node``: a number for each text of a doc_id.

    It is the doc_id for the first of its texts (by a hash) and a number from 2^62 on for each other one.
    """
    mark = F.xxhash64("text", F.col("text").isNull())
    rows = docs.filter(F.col("doc_id").isNotNull())
    texts = rows.select("doc_id", mark.alias("mark")).groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    of, lo = free_names(docs, "_several", "_first")
    several = stored(texts.filter("lo <> hi").select(F.col("doc_id").alias(of), F.col("lo").alias(lo)), "minhash-several")
    if several.isEmpty():
        return rows.withColumn(node, F.col("doc_id"))
    met = rows.join(several, F.col("doc_id") == F.col(of), "left")
    other = F.shiftrightunsigned(F.xxhash64("doc_id", mark), 2).bitwiseOR(F.lit(1 << 62))
    return met.withColumn(node, F.when(mark != F.col(lo), other).otherwise(F.col("doc_id"))).drop(of, lo)


def unique_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns doc_id and text among them) that are kept, one of each group of near duplicates, all columns.

    Unlike texts under one doc_id are documents of their own, so each of their groups keeps a row; the rows of one doc_id
    and text count as one, of which the least by a hash of its columns stays. Rows without doc_id stay as they are. An
    empty table gives an empty result. Other columns may have any names and types.
    """
    node, one_of, row = free_names(docs, "_node", "_kept", "_row")
    named = _named_rows(docs, node)
    kept = near_duplicates(named.select(node, "text"), doc_id=node).filter("kept").select(F.col("doc_id").alias(one_of)).distinct()
    one = named.join(kept, F.col(node) == F.col(one_of), "left_semi")
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = one.groupBy(node).agg(F.min_by(columns, row_mark(docs)).alias(row)).select(f"{row}.*")
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))
