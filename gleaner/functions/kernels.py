"""The functions of text.py that need match offsets, on one text: for single texts, and as brute force in tests."""

from __future__ import annotations

import re
from functools import lru_cache

from . import text as T

QUOTED = re.compile(T.QUOTE)
TOKEN = re.compile(r"[\w']+")
BEFORE = T.BEFORE

compiled = lru_cache(4096)(re.compile)


def quote_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in QUOTED.finditer(text or "")]


def negated(text: str, start: int, negators, phrases=()) -> bool:
    """Whether one of the BEFORE tokens before start is a negator, or they hold a negating phrase."""
    size = 400
    while True:
        begin = max(0, start - size)
        last = [t.lower() for t in TOKEN.findall(text[begin:start])]
        if begin and len(last) <= BEFORE:  # the first one may be cut
            size *= 4
            continue
        last = last[-BEFORE:]
        break
    return any(t in negators for t in last) or any(p in " ".join(last) for p in phrases)


def pattern_hit(text: str, patterns, negators, phrases=()) -> tuple[bool, bool]:
    """(found, found outside quotes) over matches that are not negated."""
    spans, found = quote_spans(text), False
    for p in patterns:
        for m in compiled(p, re.I).finditer(text):
            if not negated(text, m.start(), negators, phrases):
                found = True
                if not any(a <= m.start() < b for a, b in spans):
                    return True, True
    return found, False


def gated_mentions(text: str, word: str, context: str, before: int = 300, name: str | None = None) -> int:
    """Mentions of a word with the context within before characters, without those whose full name ends or stands up to 20
    characters before them."""
    full, total = f"{name} {word}".lower(), 0
    for m in compiled(rf"\b{re.escape(word)}\b", re.I).finditer(text or ""):
        around = text[max(0, m.start() - before) : m.end() + before]
        total += bool(compiled(context, re.I).search(around)) and not (name and full in text[max(0, m.start() - 20) : m.end()].lower())
    return total


def centrality(headline: str, body: str, pattern: str) -> tuple[float, float, float, float, float, float]:
    """head, lede, density, plain, subject and total of text.centrality()."""
    hit, body = compiled(pattern, re.I), body or ""
    sentences = [s.strip() for s in re.split(T.SENTENCE_END, body) if s.strip()]
    at = [m.span() for m in hit.finditer(body)]
    rate = 100 * len(at) / max(1, len(body.split()))
    sources = sum(bool(compiled(T.SOURCE_BEFORE, re.I).search(body[max(0, a - T.NEAR_BEFORE) : a]) or compiled(T.SOURCE_AFTER, re.I).search(body[b : b + T.NEAR_AFTER])) for a, b in at)
    opening = sum(a < T.NEAR_START or any(c in body[a - T.NEAR_START : a] for c in ".!?\n") for a, _ in at)
    parts = float(bool(hit.search(headline or ""))), float(bool(hit.search(" ".join(sentences[: T.LEDE])))), rate / (rate + 1), 1 - sources / len(at) if at else 0.0, opening / len(at) if at else 0.0
    return (*parts, round(sum(w * x for w, x in zip(T.CENTRALITY.values(), parts, strict=True)), 4))
