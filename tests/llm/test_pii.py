"""Personal data: base spans against plain regular expressions, and what the context adds."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from encore.llm import pii
from encore.llm.common import table
from encore.llm.identifiers import KINDS, base_spans, candidate_spans
from tests.llm.conftest import documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        x = int(c) * (2 if k % 2 else 1)
        total += x // 10 + x % 10
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and checksum(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }
            if good[kind]():
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.one_of(
    st.text("0123456789. -+()@a%é", max_size=40),
    st.lists(st.sampled_from(["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", " ", "x", "-", "+", "..", "1"]), max_size=12).map("".join),
))
def test_base_spans(text):
    base = base_spans(text)
    assert base == plain(text)
    loose, other = candidate_spans(text, base)
    for a, b, _ in [*loose, *other]:
        assert not any(x < b and a < y for x, y, _ in base)


def test_rows(spark, odd, odd_rows, none):
    text = "é mail joe@x.org, ip 10.0.0.1 card 4111 1111 1111 1111 call +1 (555) 010-9999."
    rows = odd.unionByName(documents(spark, [(40, text, "en", "s"), (40, text, "en", "s")], clash=True))
    got = pii.identifier_rows(rows).collect()
    assert len(got) == len(odd_rows) + 2
    want = ",".join(f"{k}:{a}:{b}" for a, b, k in plain(text))
    for r in got:
        if r.doc_id == 40:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans == want
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        else:
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.identifier_rows(none).collect() == []


def test_context_discovers_unseen_identifiers(spark):
    """Seeds make `phone number: _` a pattern; it finds phones without a plus, and what it finds counts elsewhere."""
    rows = [(k, f"please call phone number: +1 555 010 {1000 + k} today", "en", "s") for k in range(12)]
    rows += [(100 + k, f"please call phone number: 555-020-{1000 + k} today", "en", "s") for k in range(3)]
    rows += [(200, "somewhere else 555-020-1001 again", "en", "s"), (300, "version 555-030-1000 of it", "en", "s")]
    rows += [(400 + k, f"mail to: user{k}@example.org now", "en", "s") for k in range(8)]
    rows += [(500, "mail to: hidden (at) example (dot) org now", "en", "s"), (501, "we met at home dot", "en", "s")]
    got = {r.doc_id: r for r in pii.identifier_rows(documents(spark, rows)).collect()}
    for k in range(3):
        start = rows[12 + k][1].index("555")
        assert got[100 + k].spans == f"phone:{start}:{start + 12}" and got[100 + k].n_phone == 0
    assert got[200].spans == "phone:15:27"
    assert got[300].spans == "" and got[501].spans == ""
    assert got[500].spans.startswith("email:9:")


def test_unseen_identifiers_may_outnumber_the_seeds(spark):
    """A clean context is confident however many unseen candidates of its kind stand in it; other digits in it count against it."""
    rows = [(k, f"w{k}a phone: +1 555 010 {1000 + k} b{k}x", "en", "s") for k in range(20)]
    rows += [(100 + k, f"w{k}c phone: 555-020-{1000 + k} d{k}x", "en", "s") for k in range(60)]
    rows += [(200 + k, f"w{k}e code: +1 555 040 {1000 + k} f{k}x", "en", "s") for k in range(20)]
    rows += [(300 + k, f"w{k}g code: {k}7x{k} h{k}x +", "en", "s") for k in range(60)] + [(400, "i code: 555-050-1000 j", "en", "s")]
    got = {r.doc_id: r for r in pii.identifier_rows(documents(spark, rows)).collect()}
    for k in range(60):
        start = rows[20 + k][1].index("555")
        assert got[100 + k].spans == f"phone:{start}:{start + 12}"
    assert got[400].spans == ""


def plain_scores(rows):
    """The graph's scores from the definition, edge by edge."""
    edges = {}
    for kind, instance, pattern, seed in rows:
        edges[kind, instance, pattern] = edges.get((kind, instance, pattern), False) or seed
    seeds = {(k, i) for (k, i, _), seed in edges.items() if seed}
    score = {(k, i): float((k, i) in seeds) for k, i, _ in edges}
    for _ in range(pii.ROUNDS):
        good = {}
        for kind, pattern in {(k, p) for k, _, p in edges if k != "other"}:
            own = [score[k, i] for k, i, p in edges if k == kind and p == pattern]
            others = sum(p == pattern and k != kind for k, _, p in edges)
            confidence = sum(own) / (sum(own) + others + 1)
            if confidence >= pii.PATTERN_CONFIDENCE and sum(s >= pii.INSTANCE_SCORE for s in own) >= pii.PATTERN_SUPPORT:
                good[kind, pattern] = confidence
        new = {}
        for kind, instance in score:
            miss = 1.0
            for k, i, p in edges:
                if (k, i) == (kind, instance):
                    miss *= 1 - good.get((k, p), 0.0)
            new[kind, instance] = 1.0 if (kind, instance) in seeds else 1 - miss
        score = new
    return score


def test_graph_against_plain_scores(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        kind = rng.choice([*KINDS, "other"])
        pattern = f"{kind if rng.random() < 0.8 else 'mixed'}{rng.randrange(4)}"
        instance = rng.randrange(60)
        rows.append((kind, f"i{instance}", pattern, kind != "other" and instance % 3 == 0))
    got, _ = pii.score_graph(spark.createDataFrame(rows, "kind string, instance string, pattern string, seed boolean"))
    want = plain_scores(rows)
    found = {(r.kind, r.instance): r.score for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-9 for k, v in want.items())
    assert any(0 < v < 1 for v in want.values())


def test_discovery_in_the_given_texts(spark):
    """Unseen identifiers planted into the given documents, in contexts that known ones share: recall and precision."""
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").limit(500).collect()]
    rng, rows, planted = random.Random(8), [], {}
    shapes = {
        "phone": ("call us on", lambda n: f"+1 555 010 {n}", lambda n: f"555-020-{n}"),
        "email": ("write to", lambda n: f"u{n}@mail.example.org", lambda n: f"u{n} (at) mail (dot) org"),
        "card": ("card number:", lambda n: "4111 1111 1111 1111", lambda n: f"4111 1111 {n} 1112"),
    }
    for k, (i, text) in enumerate(docs):
        text = text or ""
        if k % 5 < 3:
            kind = list(shapes)[k % 5]
            lead, known, unseen = shapes[kind]
            at = text.find(" ", rng.randrange(max(1, len(text))))
            at = len(text) if at < 0 else at
            new = k // 5 % 2 == 1
            body = (unseen if new else known)(rng.randrange(1000, 9999))
            if kind == "card" and not new:
                body = f"4{rng.randrange(10**14):014d}"
                body += next(str(d) for d in range(10) if checksum(body + str(d)))
            text = f"{text[:at]} {lead} {body} please{text[at:]}"
            if new:
                planted[i] = (kind, at + 2 + len(lead), at + 2 + len(lead) + len(body))
        rows.append((i, text, "en", "s"))
    got = pii.find_identifiers(documents(spark, rows)).collect()
    added = {(r.doc_id, s.kind, s.start, s.end) for r in got for s in r.spans if s not in r.base}
    want = {(i, *span) for i, span in planted.items()}
    recall, precision = len(added & want) / len(want), len(added & want) / max(1, len(added))
    print("planted", len(want), "recall", recall, "precision", precision)
    assert recall >= 0.9 and precision >= 0.9
