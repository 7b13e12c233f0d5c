"""Identifiers in one text: the base patterns, looser candidates, and the words around them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no start within a run of digits: it would end as the run's first digit does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]|[(\[]at[)\]]| dot ", re.IGNORECASE)

# candidates: shapes of each kind that the base patterns do not take
_SPELT_AT = re.compile(r"(?: ?[(\[]at[)\]] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[A-Za-z]{2,24})+", re.IGNORECASE)
_SPELT = re.compile(r"[(\[]at[)\]]| dot ", re.IGNORECASE)
_BARE_HOST = re.compile(r"[A-Za-z0-9-]+")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_PLAIN_PHONE = re.compile(r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z])")
_OTHER = re.compile(r"[0-9][0-9A-Za-z.:/-]*+")

Span = tuple[int, int, str]


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        x = int(d) * (1 + place % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Addresses, leftmost and without overlap; with a flag, those whose host has no dot."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, done)
        if start < at:
            if host := _DOMAIN.match(text, at + 1):
                done = host.end()
                yield start, done, True
            elif host := _BARE_HOST.match(text, at + 1):
                yield start, host.end(), False
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the base patterns, by start, then kind; each kind leftmost and without overlap."""
    found: list[Span] = []
    if not _SIGN.search(text):
        return found
    found += [(a, b, "email") for a, b, whole in _emails(text) if whole]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for a, b, _ in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _free(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether no covered stretch reaches into a..b."""
    k = bisect_right(taken[1], a)
    return k == len(taken[0]) or taken[0][k] >= b


def candidate_spans(text: str, base: list[Span]) -> tuple[list[Span], list[Span]]:
    """Spans that look like identifiers but for the base patterns, and other runs with digits (kind `other`); none touches a base span or one before it."""
    if not _SIGN.search(text):
        return [], []
    taken = _merged(base)
    loose: list[Span] = [(a, b, "email") for a, b, whole in _emails(text) if not whole]
    if _SPELT.search(text):
        for m in _SPELT_AT.finditer(text):
            start = _local_start(text, m.start(), 0)
            if start < m.start() and _SPELT.search(m.group()):
                loose.append((start, m.end(), "email"))
    loose += [(*m.span(), "ip") for m in _IP6.finditer(text)]
    loose += [(*m.span(), "card") for m in _CARD.finditer(text) if 12 <= len(_digits(m.group())) <= 19]
    loose += [(*m.span(), "phone") for m in _PLAIN_PHONE.finditer(text) if 7 <= len(_digits(m.group())) <= 15]
    kept: list[Span] = []
    for a, b, kind in sorted(loose, key=lambda s: (s[0], KINDS.index(s[2]), s[1])):
        if _free(taken, a, b) and (not kept or kept[-1][1] <= a):
            kept.append((a, b, kind))
    taken = _merged([*base, *kept])
    return kept, [(*m.span(), "other") for m in _OTHER.finditer(text) if _free(taken, *m.span())]


def instance(text: str) -> str:
    """What an identifier stands for, however it is written: its letters and digits in lower case."""
    return "".join(c for c in text.lower() if c.isalnum())


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before; a word before and one behind; the word before, if it ends in a colon or equals sign."""

    def plain(words: list[str]) -> list[str]:
        return ["".join("0" if c.isdigit() else c for c in w.lower()) for w in words]

    left = ["^", "^", *plain(text[max(0, start - 80) : start].split())][-2:]
    right = [*plain(text[end : end + 40].split()), "$"][:1]
    out = [f"{left[0]} {left[1]} _", f"{left[1]} _ {right[0]}"]
    if left[1].endswith((":", "=")):
        out.append(f"{left[1]} _")
    return out
