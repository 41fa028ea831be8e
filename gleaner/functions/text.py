"""Text functions as Column builders; all stay in the JVM."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r'(?<=[.!?])\s+(?=[A-Z"])'


def let(expr: Column, body) -> Column:
    """body(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def literal(words) -> Column:
    return F.array(*map(F.lit, words))


def clean(text: Column) -> Column:
    """Lower case, curly quotes straightened, white space collapsed."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def first_words(text: Column, n: int, more: str = "") -> Column:
    """The text itself if it has at most n words, else its first n joined by blanks, with more behind.  White space is what SQL's \\s
    matches, without the vertical tab."""
    return let(F.filter(F.split(text, r"[\t\n\f\r ]+"), lambda w: w != ""), lambda w: F.when(F.size(w) <= n, text).otherwise(F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(more))))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def keyword_score(text: Column, keywords) -> Column:
    """How many keywords occur; those of up to three characters as whole words, others as substrings of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.regexp_like(low, F.lit(rf"\b{re.escape(k)}\b")) if len(k) <= 3 else F.contains(low, F.lit(k)) for k in keywords]
    return sum((h.cast("long") for h in hits), F.lit(0).cast("long"))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def windows(text: Column, pattern: str, k: int) -> Column:
    """For each sentence that the pattern hits, it and k // 2 sentences on either side."""

    def of(s):
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.regexp_like(F.lower(F.get(s, i)), F.lit(pattern)))
        low = lambda i: F.greatest(i - k // 2, F.lit(0))
        return F.when(F.size(s) > 0, F.transform(at, lambda i: F.array_join(F.slice(s, low(i) + 1, F.least(i + k // 2, F.size(s) - 1) - low(i) + 1), " "))).otherwise(F.array().cast("array<string>"))

    return let(sentences(text), of)


def variant_windows(text: Column, variants, k: int, most: int | None = None) -> Column:
    """Windows of all variants in their order, each once, the first most of them."""
    found = F.array_distinct(F.flatten(F.array(*(windows(text, rf"\b{re.escape(v.lower())}\b", k) for v in variants))))
    return F.slice(found, 1, most) if most else found


def mention_pattern(variants) -> str:
    """Case-insensitive alternation of whole words, longest first."""
    return r"(?i)\b(?:" + "|".join(re.escape(v) for v in sorted(variants, key=lambda v: (-len(v), v))) + r")\b"


def mentions(text: Column, variants) -> Column:
    """Count of whole-word mentions; texts that hold no variant as a substring are not searched by pattern."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    some = None
    for v in variants:
        has = F.contains(low, F.lit(v.lower()))
        some = has if some is None else some | has
    return F.when(some, F.regexp_count(t, F.lit(mention_pattern(variants)))).otherwise(0).cast("long")


def frame_fraction(text: Column, patterns) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.regexp_like(low, F.lit(p)).cast("double") for p in patterns), F.lit(0.0)) / len(patterns)


def argmax(columns: list[str], blank_zero: bool = True) -> Column:
    """Name of the greatest column, ties to the first; null if all are 0."""
    best = F.greatest(*map(F.col, columns))
    pick = None
    for c in reversed(columns):
        pick = F.when(F.col(c) == best, c) if pick is None else F.when(F.col(c) == best, c).otherwise(pick)
    return F.when(best > 0, pick) if blank_zero else pick


def paragraphs(text: Column, pattern: str, least: int = 10, most: int = 8) -> Column:
    """Lines of more than least words that the pattern hits, the first most of them."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: (word_count(p) > least) & F.regexp_like(F.lower(p), F.lit(pattern)))
    return F.slice(lines, 1, most)


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines; without any, between line ends."""
    def split(p):
        return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), p), lambda x: F.trim(x)), lambda x: x != "")

    return let(split(r"\n\s*\n"), lambda b: F.when(F.size(b) > 1, b).otherwise(split("\n")))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(n - 3))), F.lit("...")))


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) > 3))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's words of over three characters that b has."""
    return let(long_words(a), lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, long_words(b))) / F.size(x)).otherwise(F.lit(0.0)))


def best_block(text: Column, needle: Column) -> Column:
    """The block that holds needle, else the one of largest overlap, else the first."""
    def pick(b):
        verbatim = F.get(F.filter(b, lambda x: F.contains(x, needle)), F.lit(0))
        scored = F.array_sort(F.transform(b, lambda x, i: F.struct((-overlap(needle, x)).alias("s"), i.alias("i"), x.alias("x"))))
        return F.coalesce(verbatim, F.get(scored, F.lit(0))["x"])

    return let(blocks(text), pick)


def focus(text: Column, pattern: str, most: int = 3) -> Column:
    """The most blocks of highest hit count, in text order."""
    def pick(b):
        scored = F.transform(b, lambda x, i: F.struct((-F.regexp_count(F.lower(x), F.lit(pattern))).alias("s"), i.alias("i"), x.alias("x")))
        best = F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), 1, most)
        return F.array_join(F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"]), " [...] ")

    return let(blocks(text), pick)


def grounded(text: Column, quote: Column) -> Column:
    """Whether the text has the quote, or its first eight words if it has at least five."""
    t, q = clean(text), clean(quote)
    start = F.array_join(F.slice(F.split(q, " "), 1, 8), " ")
    return F.contains(t, q) | ((F.size(F.split(q, " ")) >= 5) & F.contains(t, start))


def fold_label(label: Column) -> Column:
    """Lower case, blanks and hyphens to underscores, 2.0 to 2."""
    low = F.regexp_replace(F.lower(F.trim(label)), r"[\s\-]+", "_")
    return F.when(F.regexp_like(low, F.lit(r"^\d+\.0+$")), F.regexp_replace(low, r"\.0+$", "")).otherwise(low)


def fold_attribute(value: Column) -> Column:
    """yes/no and true/false to true/false, otherwise lower case without outer blanks."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false").otherwise(low)


#: Fixed value: quoted speech, between straight or curly marks.
QUOTE = r'"[^"]{2,600}"|“[^“”]{2,600}”'
#: Letters, digits and underscores of any script, as a class of Java and RE2 expressions.
WORDLY = r"\p{L}\p{N}_"
BEFORE = 4  #: fixed value: tokens before a match in which a negator counts


def fraction_quoted(text: Column) -> Column:
    """Share of characters inside straight or curly quotation marks, 2 to 600 characters long."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit(QUOTE), F.lit(0))
    inside = F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.length(t) > 0, inside / F.length(t)).otherwise(F.lit(0.0))


SPANS = "array<struct<start:int,end:int>>"


def positions(text: Column, pattern: str) -> Column:
    """start and end (code points from 0, end exclusive) of a pattern's matches: the lengths of matches and of what lies between add up."""
    t = F.coalesce(text, F.lit(""))
    lengths = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(a, x):
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"))
        return F.struct((start + x["size"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    found = F.aggregate(F.filter(lengths, lambda x: x["size"] > 0), begin, step, lambda a: a["out"])
    return F.when(F.regexp_like(t, F.lit(pattern)), found).otherwise(F.array().cast(SPANS))


def part(text: Column, start: Column, end: Column) -> Column:
    """Characters start to end, cut to the text."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(end - low, F.lit(0)))


def negated(text: Column, start: Column, negators, phrases=()) -> Column:
    """Whether one of the BEFORE tokens before start is a negator, or they hold a negating phrase.

    The text before is reversed, so that one anchored match takes these tokens, however far back they stand.
    """
    token, other = rf"[{WORDLY}']", rf"[^{WORDLY}']"
    back = F.regexp_extract(F.reverse(F.substring(text, F.lit(1), start)), rf"^{other}*((?:{token}+(?:{other}+|$)){{1,{BEFORE}}})", 1)
    tokens = F.filter(F.split(F.lower(F.reverse(back)), rf"{other}+"), lambda x: x != "")
    found = F.arrays_overlap(tokens, literal(sorted(negators)))
    for p in phrases:
        found = found | F.contains(F.array_join(tokens, " "), F.lit(p))
    return found


def pattern_hit(text: Column, patterns, negators, phrases=()) -> tuple[Column, Column]:
    """Whether there is a match that is not negated, and one outside quoted speech.

    A text is cut at its matches once, and what stands before a match is carried along as far as its last BEFORE tokens reach, so
    no match reads the text before it again; after a match that settles both answers nothing more is read.
    """
    t = F.coalesce(text, F.lit(""))
    token, other = rf"[{WORDLY}']", rf"[^{WORDLY}']"
    tail = rf"^{other}*(?:{token}+(?:{other}+|$)){{1,{BEFORE}}}"  # of a reversed text

    def told(back):
        tokens = F.filter(F.split(F.lower(F.reverse(back)), rf"{other}+"), lambda x: x != "")

        def of(w):
            found = F.arrays_overlap(w, literal(sorted(negators)))
            for p in phrases:
                found = found | F.contains(F.array_join(w, " "), F.lit(p))
            return found

        return let(tokens, of)

    def hits(pattern, quotes, begin):
        pieces = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("match")))
        start = F.struct(begin["found"].alias("found"), begin["outside"].alias("outside"), F.lit(0).alias("at"), F.lit("").alias("back"))

        def step(a, x):
            def of(y):  # back: the last tokens before the match, reversed
                new = ~told(y["back"])
                return F.struct(
                    (a["found"] | new).alias("found"),
                    (new & ~inside(y["at"], quotes)).alias("outside"),
                    (y["at"] + F.length(x["match"])).alias("at"),
                    F.concat(F.reverse(x["match"]), y["back"]).alias("back"),
                )

            before = F.struct((a["at"] + F.length(x["gap"])).alias("at"), F.regexp_extract(F.concat(F.reverse(x["gap"]), a["back"]), tail, 0).alias("back"))
            return F.when(a["outside"], a).otherwise(let(before, of))

        some = F.filter(pieces, lambda x: F.length(x["match"]) > 0)  # the last piece has no match
        return F.when(begin["outside"] | ~F.regexp_like(t, F.lit(pattern)), begin).otherwise(F.aggregate(some, start, step, lambda a: F.struct(a["found"].alias("found"), a["outside"].alias("outside"))))

    def over(quotes):
        out = F.struct(F.lit(False).alias("found"), F.lit(False).alias("outside"))
        for p in patterns:
            out = let(out, partial(hits, f"(?i){p}", quotes))
        return out

    both = let(positions(t, QUOTE), over)
    return both["found"], both["outside"]


def gated_mentions(text: Column, word: str, context: str, name: str | None = None, around: int = 300, lead: int = 20) -> Column:
    """Mentions of a word with the context (a pattern) within around characters, without those that end the full name, or
    have it in the lead characters before them."""
    t = F.coalesce(text, F.lit(""))

    def counts(m):
        near = F.regexp_like(part(t, m["start"] - around, m["end"] + around), F.lit(f"(?i){context}"))
        return near if name is None else near & ~F.contains(F.lower(part(t, m["start"] - lead, m["end"])), F.lit(f"{name} {word}".lower()))

    return F.size(F.filter(positions(t, rf"(?i)\b{re.escape(word)}\b"), counts)).cast("long")


#: Fixed values of the centrality score: weights, cues that a mention is a source, and how near they and a sentence's start are.
CENTRALITY = {"head": 0.25, "lede": 0.15, "density": 0.20, "plain": 0.25, "subject": 0.15}
SOURCE_BEFORE = r"(?:according to|per|says?|said|told|stated|noted|added|argued|claimed|announced|confirmed)\s*$"
SOURCE_AFTER = r"^\s*(?:said|says?|told|stated|noted|added|argued|claimed|announced|confirmed|according)"
NEAR_BEFORE, NEAR_AFTER, NEAR_START, LEDE = 30, 20, 40, 3


def centrality(headline: Column, body: Column, pattern: str) -> dict[str, Column]:
    """How far a text is about a name: head and lede (whether it is there), density (mentions per 100 words, saturating),
    plain (share of mentions that no verb of speech marks as a source), subject (share near the start of a sentence), n, total."""
    t, hit = F.coalesce(body, F.lit("")), f"(?i){pattern}"
    found = positions(t, hit)
    n = F.size(found).cast("long")
    head = F.regexp_like(F.coalesce(headline, F.lit("")), F.lit(hit)).cast("double")
    lede = F.regexp_like(F.array_join(F.slice(sentences(t), 1, LEDE), " "), F.lit(hit)).cast("double")
    rate = F.lit(100.0) * n / F.greatest(word_count(t), F.lit(1))

    def source(m):
        return F.regexp_like(part(t, m["start"] - NEAR_BEFORE, m["start"]), F.lit(f"(?i){SOURCE_BEFORE}")) | F.regexp_like(part(t, m["end"], m["end"] + NEAR_AFTER), F.lit(f"(?i){SOURCE_AFTER}"))

    def opens(m):
        return (m["start"] < NEAR_START) | F.regexp_like(part(t, m["start"] - NEAR_START, m["start"]), F.lit(r"[.!?\n]"))

    share = lambda f: F.when(n > 0, F.size(F.filter(found, f)) / n).otherwise(0.0)
    out = {"head": head, "lede": lede, "density": rate / (rate + 1), "plain": F.when(n > 0, 1 - share(source)).otherwise(0.0), "subject": share(opens)}
    return out | {"n": n, "total": F.round(sum((out[k] * w for k, w in CENTRALITY.items()), F.lit(0.0)), 4)}


def inside(position: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (position >= s["start"]) & (position < s["end"]))


def tolerant_json(text: Column) -> Column:
    """A map from JSON, from JSON without its braces, or from loose key: value pairs."""
    kind = "map<string,string>"
    pairs = F.regexp_extract_all(text, F.lit(r'"?(\w+)"?\s*[:=]\s*"?([^",;{}]+)"?'), F.lit(0))
    loose = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r'"?(\w+)"?\s*[:=]', 1), F.trim(F.regexp_extract(p, r'[:=]\s*"?([^",;{}]+)', 1))))
    whole, braced = F.from_json(text, kind), F.from_json(F.concat(F.lit("{"), text, F.lit("}")), kind)
    return F.when(F.map_keys(whole).isNotNull() & (F.size(F.map_keys(whole)) > 0), whole).when(F.size(F.map_keys(braced)) > 0, braced).when(F.size(loose) > 0, F.map_from_entries(loose))


def closed_vocabulary(attributes: Column, allowed: dict[str, list[str]]) -> Column:
    """'k=v; k=v' of the attributes whose value the vocabulary has, by key."""
    test = F.map_filter(attributes, lambda k, v: F.coalesce(F.array_contains(F.element_at(F.create_map(*(x for key, values in allowed.items() for x in (F.lit(key), literal(values)))), k), v), F.lit(False)))
    return F.array_join(F.transform(F.array_sort(F.map_entries(test)), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")


def sorted_json(attributes: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attributes))))
