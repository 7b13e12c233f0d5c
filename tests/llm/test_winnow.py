"""Fingerprints against a plain winnowing."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from encore.llm import winnow
from tests.llm.conftest import documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, gram=winnow.GRAM, window=winnow.WINDOW):
    units = [w[k : k + 8] for w in WORD.findall(text) for k in range(max(1, len(w) - 7))]
    if not units:
        return []
    units = [""] * (gram - len(units)) + units
    codes = [zlib.crc32(u.encode()) % winnow.MODULUS for u in units]
    hashes = []
    for i in range(len(codes) - gram + 1):
        h = 0
        for c in codes[i : i + gram]:
            h = (h * winnow.BASE + c) % winnow.MODULUS
        hashes.append(h)
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        at = max(k for k, h in enumerate(part) if h == min(part))
        if not out or out[-1] != (part[at], i + at):
            out.append((part[at], i + at))
    return out


def likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def text_of(marks):
    return ",".join(f"{h}:{p}" for h, p in marks)


def check(spark, rows):
    df = documents(spark, [(i, t, "en", "s") for i, t in rows], clash=True)
    got = winnow.fingerprints(df).collect()
    assert len(got) == len(rows)
    distinct = {(i, t or "") for i, t in rows}
    # rows of one doc_id stand in the order of a hash of the text
    marks = {
        (r.doc_id, r.text): r.m
        for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("m", F.xxhash64("text", F.col("doc_id").isNull())).collect()
    }
    order = sorted(distinct, key=lambda x: (x[0] is None, -(x[0] or 0), marks[x]))
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain(t), plain(edited), plain(after)
        row = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), round(likeness(a, b), 9), round(likeness(a, c), 9))
        want[i, t] = row
    expected = sorted(str(want[i, t or ""]) for i, t in rows)
    assert sorted(str((*r[:5], round(r.near_edited, 9), round(r.near_next, 9))) for r in got) == expected


def test_against_plain(spark):
    check(spark, [(k * 7 % 31, " ".join(words(k, k * 3))) for k in range(31)])


def test_odd_rows(spark, odd_rows, none):
    check(spark, [(i, t) for i, t, *_ in odd_rows])
    check(spark, [(5, "alone a b c d e f")])
    assert winnow.fingerprints(none).collect() == []


def test_match_guarantee(spark):
    """Texts that share GRAM + WINDOW - 1 units in a row share a mark, at the same place of the run."""
    run = words(1, winnow.GRAM + winnow.WINDOW - 1, 10**6)
    rows = [(k, " ".join(words(10 + k, 13 * k) + run + words(50 + k, 29 - k))) for k in range(12)]
    df = spark.createDataFrame(rows, "i long, t string")
    got = {r.i: r.m for r in winnow.with_marks(df, "t", "m").collect()}
    hashes = {i: {m >> 32 for m in ms} for i, ms in got.items()}
    assert all(hashes[0] & h for h in hashes.values())


def test_unspaced_passage_at_any_offset(spark):
    """A shared run of 16 characters inside long words leaves a shared mark, wherever it stands in each."""
    rng = random.Random(5)

    def signs(n):
        return "".join(rng.choice("的一是不了人我在有他这𝒳") for _ in range(n))

    run = signs(winnow.GRAM + winnow.WINDOW - 1 + 7)
    rows = [(k, signs(k) + run + signs(17 - k)) for k in range(9)] + [(9 + k, "x " + signs(40) + signs(k) + run + " y") for k in range(9)]
    df = spark.createDataFrame(rows, "i long, t string")
    got = {r.i: {m >> 32 for m in r.m} for r in winnow.with_marks(df, "t", "m").collect()}
    for i in got:
        assert all(got[i] & got[j] for j in got), i


def test_packed_positions(spark):
    """A packed fingerprint reads as the fingerprint, with positions on either side of 2^8, 2^16 and 2^24."""
    top = (1 << 32) - 1
    places = [[], [0], [3, 255, 256, 65535], [0, 65535, 65536, 70000], [5, 1 << 24, (1 << 31) + 7, top]]
    rows = [([(((k * 977 + p) % winnow.MODULUS) << 32) + top - p for p in ps],) for k, ps in enumerate(places)]
    df = spark.createDataFrame(rows, "m array<long>")
    for r in df.select("m", *winnow.packed(F.col("m"))).select(winnow.as_text(F.col("m")).alias("want"), winnow.packed_text().alias("got"), F.size("m").alias("n")).collect():
        assert r.got == r.want and r.want.count(":") == r.n


def test_other_sizes(spark):
    df = spark.createDataFrame([(" ".join(words(3, 90)),)], "t string")
    for gram, window in ((1, 1), (3, 4), (5, 7), (6, 2), (7, 8)):
        marks = winnow.with_marks(df, "t", "m", gram, window).first().m
        top = (1 << 32) - 1
        assert [(m >> 32, top - (m & top)) for m in marks] == plain(df.first().t, gram, window), (gram, window)


def test_texts_are_dealt_out_once(spark):
    """Both joins of texts read one exchange, so marks are computed once."""
    rows = [(k, " ".join(words(k, 30)), "en", "s") for k in range(20)]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        out = winnow.fingerprints(documents(spark, rows))
        out.collect()
    finally:
        spark.conf.set(limit, before)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
