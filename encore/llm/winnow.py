"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import stored

#: Units of a gram, and grams of a window. A shared run of GRAM + WINDOW - 1 units leaves a shared mark.
GRAM, WINDOW = 4, 6
#: A unit: a word of up to 8 characters, or each run of 8 characters of a longer one, so that the units of unspaced text
#: do not depend on where it begins. The group is the unit; a match takes a word's end whole, else one character.
UNIT = r"(?=([^\x20\x09-\x0D]{1,8}))(?:[^\x20\x09-\x0D]{1,8}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D])"
#: Modulus and base of the rolling hash (a prime below 2^31, so products fit a long).
MODULUS, BASE = 2147483647, 911382323


def _shifted(name: str, by: int) -> Column:
    return F.slice(F.col(name), F.lit(by + 1), F.lit(1 << 30))


def with_marks(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add the fingerprint of ``text``: an array of longs, hash * 2^32 + (2^32 - 1 - position), by position.

    Every window of ``window`` grams gives its smallest hash, the rightmost of equal ones: both
    follow from the least packed value. Texts of fewer than ``gram`` units are one gram, texts of
    fewer grams than ``window`` one window; no units, no marks. Each step is a column of its own, so that
    nothing is computed twice.
    """
    keep = df.columns
    d = df.withColumn("_units", F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(1)))
    d = d.withColumn("_count", F.size("_units"))
    fill = F.array_repeat(F.lit(""), F.lit(gram) - F.col("_count"))
    d = d.withColumn("_units", F.when(F.col("_count").between(1, gram - 1), F.concat(fill, F.col("_units"))).otherwise(F.col("_units")))
    d = d.withColumn("_count", F.greatest(F.size("_units") - (gram - 1), F.lit(0)))
    d = d.withColumn("_run1", F.transform("_units", lambda u: F.crc32(u.cast("binary")) % MODULUS))

    # hashes of runs of 1, 2, 4 ... units, and of `gram` units from those that sum to it; nulls fill
    # the ends, behind the grams that count
    def rolled(d: DataFrame, left: str, right: str, by: int, width: int, name: str) -> DataFrame:
        factor = pow(BASE, width, MODULUS)
        return d.withColumn(name, F.zip_with(F.col(left), _shifted(right, by), lambda a, b: (a * factor + b) % MODULUS))

    width, covered, grams = 1, 0, ""
    while width <= gram:
        if gram & width:
            if grams:
                d = rolled(d, grams, f"_run{width}", covered, width, f"_gram{width}")
                grams = f"_gram{width}"
            else:
                grams = f"_run{width}"
            covered += width
        if 2 * width <= gram:
            d = rolled(d, f"_run{width}", f"_run{width}", width, width, f"_run{2 * width}")
        width *= 2
    top = F.lit((1 << 32) - 1)
    d = d.withColumn("_least1", F.transform(F.slice(grams, F.lit(1), F.col("_count")), lambda h, i: F.shiftleft(h, 32) + (top - i)))
    width = 1
    while width < window:
        step = min(width, window - width)
        least = F.zip_with(F.col(f"_least{width}"), _shifted(f"_least{width}", step), lambda a, b: F.least(a, b))
        width += step
        d = d.withColumn(f"_least{width}", least)
    windows = F.greatest(F.col("_count") - (window - 1), F.least(F.col("_count"), F.lit(1)))
    d = d.withColumn(out, F.array_distinct(F.slice(f"_least{window}", F.lit(1), windows)))
    return d.select(*keep, out)


def hashes(marked: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(marked, lambda m: F.shiftright(m, 32).cast("int")))


def _position(mark: Column) -> Column:
    top = (1 << 32) - 1
    return F.lit(top) - mark.bitwiseAND(F.lit(top))


def as_text(marked: Column) -> Column:
    """hash:position, comma-joined."""
    return F.array_join(F.transform(marked, lambda m: F.concat_ws(":", F.shiftright(m, 32).cast("string"), _position(m).cast("string"))), ",")


#: Columns of a packed fingerprint.
PACKED = ["hash", "low", "mid", "rest"]


def packed(marked: Column) -> list[Column]:
    """A fingerprint in the form in which it is dealt out, as the columns PACKED: hashes, and positions as a byte, the next
    byte, and the rest, which is empty where all positions are below 2^16. Ascending positions compress well so."""

    def byte(shift: int) -> Column:
        return F.transform(marked, lambda m: (F.shiftright(_position(m), shift).bitwiseAND(F.lit(255)) - 128).cast("byte"))

    last = _position(F.element_at(marked, F.greatest(F.size(marked), F.lit(1))))
    rest = F.transform(marked, lambda m: F.shiftright(_position(m), 16).cast("int"))
    none = F.array().cast("array<int>")
    whole = F.when(F.size(marked) == 0, none).when(last < (1 << 16), none).otherwise(rest)
    columns = [F.transform(marked, lambda m: F.shiftright(m, 32).cast("int")), byte(0), byte(8), whole]
    return [c.alias(name) for c, name in zip(columns, PACKED, strict=True)]


def packed_text() -> Column:
    """as_text of the packed fingerprint in the columns PACKED."""
    low = F.zip_with("low", "mid", lambda a, b: a.cast("long") + 128 + (b.cast("long") + 128) * 256)
    whole = F.zip_with(low, F.col("rest"), lambda a, b: a + F.shiftleft(b.cast("long"), 16))
    position = F.when(F.size("rest") > 0, whole).otherwise(low)
    return F.array_join(F.zip_with(F.col("hash"), position, lambda h, p: F.concat_ws(":", h.cast("string"), p.cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 if both have none, 0 if one has."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union).cast("double")


def next_documents(keys: DataFrame) -> DataFrame:
    """For each (id, mark, absent) of ``keys``, id and mark of the next by descending id, absent ones last; the last's is the first's.

    Rows are dealt by ranges; each range is read in its own task, and only its first row meets
    those of the other ranges.
    """
    order = [F.col("absent").asc(), F.col("id").desc(), F.col("mark").asc()]
    dealt = stored(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "winnow-order")
    inside = Window.partitionBy("range").orderBy(*order)
    row = F.struct("id", "mark")
    led = dealt.withColumn("next", F.lead(row).over(inside)).withColumn("lead", F.row_number().over(inside))
    firsts = led.filter("lead = 1").select("range", row.alias("first"))
    # one row per range
    ranges = Window.orderBy("range")
    follow = firsts.select(
        F.col("range").alias("r"), F.coalesce(F.lead("first").over(ranges), F.first("first").over(ranges)).alias("after")
    )
    joined = led.join(follow, F.col("range") == F.col("r"))
    return joined.select("id", "mark", "absent", "n", F.coalesce("next", "after").alias("next"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Winnowed fingerprint of every whole text, of its edited text, and their likeness.

    Units are words (of a word above 8 characters, each run of 8), a gram is 4 units hashed by a rolling
    polynomial, and every window of 6 grams keeps its least hash, the rightmost of ties, with its
    position: texts that share 9 units in a row share a mark, unspaced texts that share 16 characters
    inside a longer word. The edited text is the text whose
    last floor(n/2) characters give way to the first as many of the next document (descending
    doc_id, then a hash of the text; the last is followed by the first; nulls last).

    Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hash:position,
    comma-joined), near_edited, near_next. Null text counts as empty; no units give an empty
    fingerprint (likeness 1 to another empty one, else 0). Rows that repeat doc_id and text count
    as one in the order and each get its row; a single document is its own next. Other columns
    are ignored. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    given_id = F.col(doc_id).cast("long")
    rows = docs.select(given_id.alias("doc_id"), F.coalesce(given_id, F.lit(0)).alias("id"), body.alias("text"))
    # (id, mark) tells documents apart and is never null, so that one dealing of rows serves all joins
    rows = rows.withColumn("mark", F.xxhash64("text", F.col("doc_id").isNull()))
    keys = rows.select("id", "mark", F.col("doc_id").isNull().alias("absent"), F.char_length("text").alias("n")).distinct()
    needs = next_documents(stored(keys, "winnow-keys")).select(
        F.col("id").alias("of_id"), F.col("mark").alias("of_mark"), F.col("next.id").alias("id"), F.col("next.mark").alias("mark"),
        F.floor(F.col("n") / 2).cast("int").alias("need"), F.when(~F.col("absent"), F.col("id")).alias("of_doc"),
    )
    needs = stored(needs, "winnow-needs")
    # each text's marks are computed once and dealt out with it; what a document needs of the next are its first
    # characters and its hashes (both joins read the same columns, so that these are dealt out once)
    texts = with_marks(rows.select("id", "mark", "text"), "text", "own").select("id", "mark", "text", *packed(F.col("own")))
    # as many hashes as there are positions, so that this join reads them as the other does
    own_hashes = F.array_distinct(F.slice("hash", F.lit(1), F.greatest(*[F.size(c) for c in PACKED])))
    given = texts.join(needs, ["id", "mark"]).select(
        F.col("of_id").alias("id"), F.col("of_mark").alias("mark"), F.col("of_doc").alias("doc_id"),
        F.substring("text", F.lit(1), F.col("need")).alias("head"), own_hashes.alias("next_hashes"),
    )
    given = given.groupBy("id", "mark").agg(*[F.first(c).alias(c) for c in ("doc_id", "head", "next_hashes")])
    both = texts.join(given, ["id", "mark"])
    n = F.char_length("text")
    both = both.select(
        "doc_id", n.cast("long").alias("n_chars"), *PACKED, "next_hashes",
        F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), "head").alias("edited"),
    )
    both = with_marks(both, "edited", "new")
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    both = both.select("*", own_hashes.alias("own_hashes"), hashes(F.col("new")).alias("new_hashes"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", packed_text().alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("new_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
