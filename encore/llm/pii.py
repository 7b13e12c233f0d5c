"""Personal data: base patterns, and contextual extraction bootstrapped from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import slices, stored
from encore.llm.identifiers import KINDS, base_spans, candidate_spans, instance, patterns

#: Rounds of scoring; confidence and known instances that a pattern needs; score that an instance needs.
ROUNDS, PATTERN_CONFIDENCE, PATTERN_SUPPORT, INSTANCE_SCORE = 3, 0.7, 3, 0.75

_SEEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
_SCHEMA = """doc_id long, text_key binary, base array<struct<start:long,end:long,kind:string>>,
    seen array<struct<start:long,end:long,kind:string,seed:boolean,instance:string,patterns:array<string>>>"""


def _digest(text: str) -> str:
    """128 bits of an identifier, so that the graph holds no personal data."""
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            keys, bases, seen = [], [], []
            for body in part.column("text").to_pylist():
                text = body or ""
                base = base_spans(text)
                loose, other = candidate_spans(text, base)
                keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                bases.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
                seen.append([
                    {"start": a, "end": b, "kind": k, "seed": known, "instance": _digest(instance(text[a:b])), "patterns": patterns(text, a, b)}
                    for spans, known in ((base, True), (loose, False), (other, False)) for a, b, k in spans
                ])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(bases, span), pa.array(seen, _SEEN)],
                names=["doc_id", "text_key", "base", "seen"],
            )


def score_graph(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of instances (kind, instance, score) and patterns (kind, pattern, confidence, support).

    ``seen`` has kind, instance, pattern, seed. Seeds score 1. A pattern's confidence for a kind is
    the summed score of its instances over that sum, the instances of other kinds that stand in it
    (other runs of digits too) and one: candidates of the kind that nothing speaks for yet are what
    is to be found, and count neither way. An instance's score is the chance that not all its confident patterns
    err. The two are computed from each other ROUNDS times, by joins and sums over distinct
    (pattern, instance) pairs; a round is written out, so its loss costs that round.
    """
    edges = stored(seen.groupBy("kind", "instance", "pattern").agg(F.max(F.col("seed").cast("int")).alias("seed")), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seeds = edges.groupBy("kind", "instance").agg(F.max("seed").alias("seed"))
    scores = seeds.select("kind", "instance", F.col("seed").cast("double").alias("score"))
    named = edges.filter(F.col("kind") != "other")
    confident = None
    for _ in range(ROUNDS):
        sums = named.join(scores, ["kind", "instance"]).groupBy("kind", "pattern").agg(
            F.sum("score").alias("sum"), F.count("*").alias("own"), F.sum((F.col("score") >= INSTANCE_SCORE).cast("int")).alias("support")
        )
        # size - own: instances of other kinds
        rated = sums.join(size, "pattern").select(
            "kind", "pattern", (F.col("sum") / (F.col("sum") + F.col("size") - F.col("own") + 1)).alias("confidence"), "support"
        )
        confident = stored(rated.filter((F.col("confidence") >= PATTERN_CONFIDENCE) & (F.col("support") >= PATTERN_SUPPORT)), "pii-patterns")
        voted = named.join(confident, ["kind", "pattern"]).groupBy("kind", "instance").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("vote")
        )
        scores = seeds.join(voted, ["kind", "instance"], "left").select(
            "kind", "instance", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("vote", F.lit(0.0))).alias("score")
        )
        scores = stored(scores, "pii-scores")
    return scores, confident


def _joined(spans: Column) -> Column:
    order = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], order[s["kind"]].alias("k"), s["end"], s["kind"])))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_identifiers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Emails, IP addresses, cards and phones in every whole text.

    Base patterns give the seeds. The words around seeds are lexical patterns; patterns and the
    instances that stand in them form a graph over the corpus, which Spark scores in rounds; looser
    candidates (spelt-out or host-only addresses, IPv6, cards failing the checksum, phones
    without a plus) that reach INSTANCE_SCORE through confident patterns are added wherever they stand.

    Returns doc_id, base and spans (arrays of start, end, kind; code points, end exclusive). Null
    text counts as empty; repeated rows are searched each; other columns are ignored; an empty
    table gives an empty result. The graph holds digests of instances, not the instances.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = stored(rows.mapInArrow(_scan, _SCHEMA), "pii-scanned")
    seen = scanned.select("text_key", F.explode("seen").alias("s")).select("text_key", "s.*")
    flat = seen.select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
    scores, _ = score_graph(flat)
    good = scores.filter((F.col("score") >= INSTANCE_SCORE)).select("kind", "instance")
    more = seen.filter(~F.col("seed") & (F.col("kind") != "other")).join(good, ["kind", "instance"], "left_semi")
    # by text, so that rows with the same text share what is found
    more = more.select("text_key", "start", "end", "kind").distinct().groupBy("text_key").agg(
        F.collect_list(F.struct("start", "end", "kind")).alias("more")
    )
    # only rows with a candidate to find meet what is found
    may = F.exists("seen", lambda s: ~s["seed"] & (s["kind"] != "other"))
    out = scanned.filter(may).select("doc_id", "text_key", "base").join(more, "text_key", "left")
    out = out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans"))
    return out.union(scanned.filter(~may).select("doc_id", "base", F.col("base").alias("spans")))


def identifier_rows(docs: DataFrame) -> DataFrame:
    """The rows of the contract: counts and digest of the base spans, and all spans."""
    found = find_identifiers(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
