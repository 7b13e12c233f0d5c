"""Mixing sources to target weights: capped water-filling, then seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import WORD, blocks_for, bucket, free_names, running_start, stored


def water_fill(sizes: list[int], weights: list[float], total: float, max_epochs: float) -> list[float]:
    """Share ``total`` by weight; clamp what exceeds ``max_epochs`` * size and share the excess again.

    Ends when no source is above its cap (or every source stands at it).
    """
    caps = [max_epochs * s for s in sizes]
    targets = [0.0] * len(sizes)
    free, rest = list(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > caps[i]]
        if not over:
            for i in free:
                targets[i] = rest * weights[i] / weight
            break
        for i in over:
            targets[i] = caps[i]
            rest -= caps[i]
        free = [i for i in free if i not in set(over)]
    return targets


def _mark(doc_id: str, text: str, source: str) -> Column:
    """Hash that, with doc_id (0 if null), tells rows apart but for copies of one text in one source; never null."""
    columns = [F.col(text).cast("string"), F.col(source).cast("string")]
    return F.xxhash64(*columns, *[c.isNull() for c in columns], F.col(doc_id).isNull())


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How many words of each row the mix takes.

    Sources in code-point order (null last) get ``weights`` in turn and share ``share`` times all
    words; water-filling holds each at ``max_epochs`` times its size. A source with target T and
    size S takes every document T // S times and, in a seeded random order, one more repetition
    until T is met to the word; only the document at that point is taken in part. The order is cut
    into blocks, so a hot source is neither sorted nor gathered in one task, and reruns agree.

    Returns doc_id, source, size (words), source_size, target, taken, start (words of the source
    before this row in the order), mark (a hash of the row's text and source). Null or empty text has size 0 and is taken 0 times; a source
    without words has target 0; repeated rows are rows of their own; an empty table gives an empty
    result. Other columns are ignored. The driver holds one row per source: a mix names its
    sources, so their number is set by the mix and not by the corpus.
    """
    narrow = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _mark(doc_id, text, source).alias("mark"),
        ),
        "mix-sizes",
    )
    per = narrow.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    per.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    targets = water_fill(
        [r.s for r in per], [weights[i % len(weights)] for i in range(len(per))], share * sum(r.s for r in per), max_epochs
    )
    plan = []
    for i, (r, t) in enumerate(zip(per, targets, strict=True)):
        words = min(round(t), int(max_epochs * r.s))
        whole = words // r.s if r.s else 0
        plan.append((i, r.source, r.s, t, whole, words - whole * r.s))
    sources = docs.sparkSession.createDataFrame(
        plan, "source_ix int, plan_source string, source_size long, target double, whole long, part long"
    )
    rows = narrow.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    # rows without doc_id are told apart by their mark, so that they spread over the order too
    seeded = F.xxhash64(F.lit(seed).cast("long"), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("mark")))
    rows = rows.withColumn("order", seeded).withColumn("block", bucket(blocks_for(sum(r.n for r in per)), F.col("order")))
    rows = running_start(rows, ["source_ix"], "block", ["order", "doc_id", "size", "mark"], "size", "start")
    extra = F.least(F.greatest(F.col("part") - F.col("start"), F.lit(0)), F.col("size"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"), "start", "mark",
    )


def mix_rows(docs: DataFrame) -> DataFrame:
    """The rows of the contract."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, the last repetition cut to its words.

    ``docs`` has the columns of documents. Rows meet their plan by doc_id, text and source; copies that agree in these
    stand next to each other in the order, so they share what is taken of them, the first ones in full. n_chars of a
    cut text is that of the cut text.
    """
    # (id, mark) is never null, so that one dealing of rows serves the join and the numbering of copies
    id_, mark, p, own, k = free_names(docs, "_id", "_mark", "_p", "_taken", "_k")
    plan = mixed.groupBy(F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("mark").alias(mark)).agg(
        F.struct(
            F.min("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("copies"),
            F.min(F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).alias("whole"),
        ).alias(p)
    ).filter(F.col(p)["taken"] > 0)
    marked = docs.withColumn(id_, F.coalesce("doc_id", F.lit(0))).withColumn(mark, _mark("doc_id", "text", "source"))
    rows = marked.join(plan, [id_, mark])
    before = F.row_number().over(Window.partitionBy(id_, mark).orderBy("lang", "n_chars")) - 1
    size, whole = F.col(p)["size"], F.col(p)["whole"]
    # beyond the whole repetitions of every copy
    more = F.col(p)["taken"] - F.col(p)["copies"] * whole * size - before * size
    rows = rows.withColumn(own, whole * size + F.least(F.greatest(more, F.lit(0)), size)).filter(F.col(own) > 0)
    whole, rest = F.floor(F.col(own) / size).cast("int"), F.col(own) % size
    times = rows.withColumn(k, F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0))))
    cut = F.col(k) > whole
    words = F.regexp_extract_all(F.col("text"), F.lit("(" + WORD + ")"), F.lit(1))
    short = F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " ")
    text = F.when(cut, short).otherwise(F.col("text"))
    out = times.withColumn("text", text)
    out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
