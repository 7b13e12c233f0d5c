"""Decontamination: planted passages against a plain edit distance."""

import random

import numpy as np
import pyarrow as pa

from encore.llm import cgk
from tests.llm.conftest import documents, words


def plain_distance(a, b):
    """Word edits between a and the nearest prefix of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 11))]
        want = plain_distance(a, b)
        got = cgk.edit_distance(np.array(a), np.array(b, int), 4)
        assert got == want if want <= 4 else got == 5


def edited(item, edits, rng):
    out = list(item)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.choice("sid")
        if kind == "s":
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind == "i":
            out.insert(at, f"new{rng.randrange(10**6)}")
        else:
            del out[at]
    return out


def test_recall_and_precision():
    """Against brute force over every window: all unchanged items, 95 in 100 at the limit, nothing else."""
    rng = random.Random(8)
    items = [(k, " ".join(words(k, 12 + k % 50))) for k in range(100)]
    index = cgk.ItemIndex(cgk._items(items))
    for rate, least in ((0.0, 1.0), (0.08, 0.98), (0.15, 0.95)):
        found = 0
        for k, text in items:
            item = text.split()
            body = words(1000 + k, 80) + edited(item, int(len(item) * rate), rng) + words(2000 + k, 80)
            codes, before = cgk.word_codes(pa.array([" ".join(body)]))
            hits = {index.ids[i]: v for i, v in index.hits(codes, before)[0].items()}
            for other, (d, at) in hits.items():
                assert plain_distance(items[other][1].split(), body[at:]) <= d <= cgk.edits_allowed(len(items[other][1].split()))
            found += k in hits
        assert found >= least * len(items), rate
    clean = [" ".join(words(5000 + k, 300)) for k in range(50)]
    codes, before = cgk.word_codes(pa.array(clean))
    assert not any(index.hits(codes, before))


def test_long_items():
    """Items of 100 to 800 words at the edit limit are found, with the edits and the start that plain distance gives."""
    rng = random.Random(31)
    lengths = [41, 60, 79, 100, 200, 400, 800] * 6
    items = [(k, " ".join(words(9000 + k, n, 4000))) for k, n in enumerate(lengths)]
    index = cgk.ItemIndex(cgk._items(items))
    found = []
    for k, text in items:
        item = text.split()
        body = words(3000 + k, 50, 4000) + edited(item, cgk.edits_allowed(len(item)), rng) + words(4000 + k, 50, 4000)
        codes, before = cgk.word_codes(pa.array(["", " ".join(body), text]))
        _, changed, whole = index.hits(codes, before)
        assert whole == {k: (0, 0)}
        if k in changed:
            d, at = changed[k]
            assert d <= cgk.edits_allowed(len(item)) and plain_distance(item, body[at : at + 2 * len(item)]) == d
        found.append(k in changed)
    assert sum(found) >= 0.95 * len(found)
    assert all(f for f, n in zip(found, lengths, strict=True) if n >= 200)


def test_nearest_start():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(3) for _ in range(rng.randrange(1, 8))]
        b = [rng.randrange(3) for _ in range(rng.randrange(1, 14))]
        span = rng.randrange(len(b))
        d, at = cgk.nearest_start(np.array(a), np.array(b), span, 4)
        want = min(plain_distance(a, b[s:]) for s in range(span + 1))
        assert d == min(want, 5) and (d > 4 or plain_distance(a, b[at:]) == d)


def test_windows_pass_over_nothing():
    """Every window within the allowed edits of an item has enough known grams."""
    rng = random.Random(2)
    items = [(k, " ".join(words(k, 20 + k))) for k in range(20)]
    index = cgk.ItemIndex(cgk._items(items))
    for k, text in items:
        item = text.split()
        body = words(50, 30) + edited(item, cgk.edits_allowed(len(item)), rng)
        at = 30
        codes, before = cgk.word_codes(pa.array([" ".join(body)]))
        start, _, kind = index.windows(codes, before)
        near = plain_distance(item, body[at:]) <= cgk.edits_allowed(len(item))
        assert not near or (at, cgk.window_length(len(item))) in set(zip(start.tolist(), index.walks.lengths[kind].tolist(), strict=True)), k


def test_documents(spark, odd, odd_rows, none):
    long = " ".join(words(77, 40))
    benchmark = spark.createDataFrame(
        [(1, long), (2, "One, two."), (3, None), (None, "x"), (4, ""), (5, "...")], "item_id long, text string"
    ).selectExpr("*", "'clash' AS doc_id")
    upper = documents(spark, [(50, "before " + long.upper().replace(" ", ",  ") + " behind", "en", "s")], clash=True)
    got = {r.doc_id: r.item_ids for r in cgk.contamination(odd.unionByName(upper), benchmark).collect() if r.contaminated}
    assert got == {7: [2], 8: [2], 9: [2], 50: [1]}
    assert cgk.contamination(odd, benchmark).count() == len(odd_rows)
    clean = cgk.clean_rows(odd.unionByName(upper), benchmark)
    assert clean.columns == odd.columns and clean.count() == len(odd_rows) - 3
    assert cgk.contamination(none, benchmark).collect() == []
    assert not any(r.contaminated for r in cgk.contamination(odd, benchmark.limit(0)).collect())
    assert cgk.clean_rows(odd, benchmark.limit(0)).count() == len(odd_rows)


def test_blocks_of_items(spark, monkeypatch):
    """One row a row, whatever the blocks: repeated and null ids, repeated items."""
    items = [(k, " ".join(words(k, 15))) for k in range(8)]
    benchmark = spark.createDataFrame([*items, (3, " ".join(words(99, 15))), (3, items[3][1])], "item_id long, text string")
    rows = [(k % 5, t + " " + items[(k + 1) % 8][1], "en", "s") for k, t in items] + [(None, items[3][1], "en", "s"), (None, "x", "en", "s"), (None, None, "en", "s")]
    docs = documents(spark, rows)

    def got():
        found = sorted(map(tuple, cgk.contamination(docs, benchmark).collect()), key=str)
        return found, sorted(map(str, cgk.clean_rows(docs, benchmark).collect()))

    whole = got()
    assert len(whole[0]) == len(rows) and len(whole[1]) == 2
    assert all(r[3] == sorted(set(r[3])) and len(r[3]) == r[2] == len(r[4]) == len(r[5]) for r in whole[0])
    for block in (1, 3):
        monkeypatch.setattr(cgk, "ITEM_BLOCK", block)
        assert got() == whole


def test_memory_of_a_long_text():
    """Hashing and searching one long text takes a small multiple of its bytes."""
    import tracemalloc

    text = " ".join(words(5, 500_000, 5000))
    long_word = "x" * 5_000_000
    index = cgk.ItemIndex(cgk._items([(1, " ".join(words(6, 30)))]))
    for column in (pa.array([text]), pa.array([long_word])):
        size = len(column[0].as_py())
        tracemalloc.start()
        codes, before = cgk.word_codes(column)
        index.hits(codes, before)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20 * size, (peak, size)
