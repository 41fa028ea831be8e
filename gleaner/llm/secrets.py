"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regex is turned into a Boolean trigram query (an OR of ANDs of lower-cased trigrams every match must contain).
Documents post the trigrams that some query mentions; postings are intersected by joining them to the queries' terms and
counting; only documents that satisfy a rule's query are searched with its regex.  A rule whose regex has no mandatory
trigram is searched for in every document.

Spans count code points, end exclusive, leftmost and non-overlapping for each rule.  A null text is searched like an empty
one; repeated rows and rows of null doc_id are reported each; texts are taken whole.  An empty table gives no rows; columns
that keep does not name are left out, whatever their names.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let


@dataclass(frozen=True)
class Rule:
    """group: the capture whose length must be at least shortest (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1


#: Fixed values of the contract, in the order in which ties of start are listed.
BASE = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same matches as runs of any length with those under 24 dropped
]
#: Rules of this module's own.
OWN = [
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,20}://[^/\s:@]+:[^/\s:@]+@"),
]
MOST = 24  #: strings in an exact set, terms in a query


def _times(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    """AND of two ORs of ANDs; the weaker side is dropped if the result grows too large."""
    both = {x | y for x in a for y in b}
    return both if len(both) <= MOST else min((a, b), key=len)


def trigram_query(pattern: str) -> set[frozenset]:
    """OR of ANDs of lower-cased trigrams; {frozenset()} if nothing is mandatory."""

    def strings(found: set[str]) -> set[frozenset]:
        return {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in found}

    def walk(nodes) -> tuple[set[str] | None, set[frozenset]]:
        """The exact strings, if few; else what must hold."""
        run, query, exact = {""}, {frozenset()}, True
        for op, arg in nodes:
            own, must = item(op, arg)
            joined = {a + b for a, b in product(run, own)} if own is not None else None
            if joined is not None and len(joined) <= MOST:
                run = joined
                continue
            query, exact = _times(query, strings(run)), False
            run = own if own is not None else {""}
            query = _times(query, must)
        return (run, {frozenset()}) if exact else (None, _times(query, strings(run)))

    def item(op, arg) -> tuple[set[str] | None, set[frozenset]]:
        if op is sre.LITERAL:
            return {chr(arg).lower()}, {frozenset()}
        if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            return {chr(x).lower() for _, x in arg}, {frozenset()}
        if op is sre.SUBPATTERN:
            return walk(arg[3])
        if op is sre.BRANCH:
            parts = [walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                return set().union(*(p[0] for p in parts)), {frozenset()}
            return None, set().union(*(strings(p[0]) if p[0] is not None else p[1] for p in parts))
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            own, must = walk(body)
            if own is not None and high == 1:
                return own | {""} if low == 0 else own, {frozenset()}
            if own is not None and low == high and len(own) == 1:
                return {x * low for x in own}, {frozenset()}
            return None, must if low and own is None else {frozenset()}
        return None, {frozenset()}

    own, must = walk(parser.parse(pattern))
    terms = strings(own) if own is not None else must
    return {t for t in terms if not any(u < t for u in terms)}


def spans(t: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind): lengths of the pieces between matches and of the matches add up to offsets."""
    lengths = F.zip_with(F.split(t, rule.pattern, -1), F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size")))
    lengths = F.filter(lengths, lambda x: x["size"] > 0)
    tested = F.transform(F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a, x):
        begin = a["at"] + x["gap"]
        row = F.struct(begin.alias("start"), F.lit(order).alias("order"), (begin + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((begin + x["size"]).alias("at"), F.concat(a["out"], F.array(row)).alias("out"))

    found = F.aggregate(lengths, start, step, lambda a: a["out"])
    return F.when(t.rlike(rule.pattern), let(tested, lambda n: F.filter(found, lambda x, k: F.get(n, k) >= rule.shortest))).otherwise(F.array().cast(kind))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, h (hash of the text), rules: the kinds whose trigram query a document satisfies, from postings."""
    spark = docs.sparkSession
    terms = [(r.kind, k, t, len(term)) for r in rules for k, term in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for t in term]
    lexicon = sorted({t for _, _, t, _ in terms})
    queries = F.broadcast(spark.createDataFrame(terms, "kind string, term int, trigram string, size int"))  # as large as the rules
    low = F.lower("text")
    postings = docs.select("doc_id", "h", F.explode(let(low, lambda x: F.filter(F.array(*map(F.lit, lexicon)), lambda g: F.contains(x, g)))).alias("trigram")) if lexicon else docs.select("doc_id", "h", F.lit("").alias("trigram")).limit(0)
    met = postings.join(queries, "trigram").groupBy("doc_id", "h", "kind", "term", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    return met.groupBy("doc_id", "h").agg(F.collect_set("kind").alias("rules"))


def scan(docs: DataFrame, rules: list[Rule] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep (doc_id among it), text, and spans, sorted by start and the rules' order; keep may not name a column spans.

    The ids of candidates meet the rows as a broadcast where they are counted to be few, so texts do not move.
    """
    if "spans" in keep:
        raise ValueError("the input has a column spans already")
    rules = BASE + OWN if rules is None else rules
    rest = [c for c in keep if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"), F.struct(*rest, F.lit(0).alias("_")).alias("rest"), F.col("text").isNull().alias("was_null"))
    indexed = [r for r in rules if frozenset() not in trigram_query(r.pattern)]
    found = common.spool(candidates(rows.select("doc_id", "text", "h"), indexed).select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), "rules"), "candidates")
    rows = rows.join(common.small(found), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    each = [spans(F.col("text"), r, k) if r not in indexed else F.when(F.coalesce(F.array_contains("rules", r.kind), F.lit(False)), spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    out = rows.withColumn("spans", F.array_sort(F.concat(*each)))
    return out.select("doc_id", F.when(~F.col("was_null"), F.col("text")).alias("text"), *(F.col("rest")[c].alias(c) for c in rest), "spans")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = scan(common.spread(docs.select("doc_id", "text"))).select("doc_id", "spans")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
