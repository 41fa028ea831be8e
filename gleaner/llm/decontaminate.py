"""Benchmark decontamination by template canonicalisation.

Words become canonical: numbers, units behind a number, and names (capitalised inside a sentence) turn into typed
placeholders, other words lose case and outer punctuation.  Windows of SPAN canonical words, at least LITERAL of them not
placeholders, are hash-joined between benchmark and documents and compared word by word.  Hits are merged along diagonals
(position in the document less position in the item, up to NEAR apart).  A document is contaminated by an item if such a
place covers LEAST of the item's words, or all of a shorter item, either by windows whose values are the item's own, or by
diagonals on which every value of the item has one value in the document (so re-parameterised copies count and chance
alignments do not): the longest diagonal that is consistent, and further ones as far as they agree with it.

Beside these, all of an item of SHORT to LEAST words, and those runs of LEAST words of a longer one that hold a word outside of
all its windows, are joined by their exact words (but for case and outer punctuation), whatever kinds these are: items of
numbers, names or capitals have no other windows.  They decide where the canonical windows find nothing.  The first word of an item of up to LEAST words is also read as a
name, as it is read inside a document's sentence.

Items share windows (stock phrases, templates).  Windows that stand side by side wherever they occur, with the same words and
values, are one run; a document meets a run once, whatever items hold it, and what it covers there is handed to these at the end.  An item's windows that
other items have too, from the most shared on, do not open a pair as long as all of them together cover too little to count: a text
that meets no other window of the item cannot be contaminated by it.  This leaves the results as they are.

Hashes outside a bitmap of the benchmark's windows never leave the scan; the bitmap has a fixed size, so a larger benchmark
only lets more windows through to the join.  An item of fewer than SHORT words is matched only by a text that is nothing else.  Null or empty texts and
items match nothing; repeated items are listed each; repeated rows and rows of null doc_id are kept each.  An empty table gives
no rows, an empty benchmark leaves all rows clean; extra columns are kept, but item_ids and covered are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPAN, LITERAL, LEAST, NEAR, SHORT = 8, 4, 13, 3, 4
BITS = 1 << 24
RUNS = 100_000  #: runs' windows that may be broadcast
SALTS = 16  #: parts of a window's hits in a join that is not
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
#: Common units, as they stand behind a number.
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet mile miles mg g kg t lb lbs oz ml l gal s sec min h hr hrs hour hours day days week weeks month months year years second seconds minute minutes % percent dollar dollars euro euros cent cents usd eur km/h mph c f k kb mb gb tb w kw hz khz mhz ghz v".split())
OUTER = ".,;:!?()[]{}\"'“”‘’«»"
STOP = (".", "!", "?", ":")
CACHE = 100_000
LIT, NUM, CAP, UNIT = range(4)
MARK = {NUM: "<num>", CAP: "<name>", UNIT: "<unit>"}
STEP = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(LEAST)], "u8")
EXACT = 0x5851F42D4C957F2D  #: sets the hashes of exact runs apart, times their length


class Words:
    """Canonical form of words, each looked at once: hash of the literal, kind it may take, whether it ends a sentence."""

    def __init__(self):
        self.clear()
        self.marks = {k: xxhash.xxh3_64_intdigest(m) for k, m in MARK.items()}

    def clear(self):
        self.known: dict[str, int] = {}
        self.h, self.k, self.s = np.empty(CACHE, "u8"), np.empty(CACHE, "i1"), np.empty(CACHE, "?")

    def add(self, word: str) -> int:
        core = word.strip(OUTER) or word
        low = core.lower()
        kind = NUM if NUMBER.fullmatch(core) else UNIT if low in UNITS else CAP if core[0].isupper() else LIT
        self.known[word] = at = len(self.known)
        if at == len(self.h):
            self.h, self.k, self.s = (np.concatenate([x, np.empty_like(x)]) for x in (self.h, self.k, self.s))
        self.h[at], self.k[at], self.s[at] = xxhash.xxh3_64_intdigest(low), kind, word.endswith(STOP)
        return at

    def canonical(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and kind of every word in its place, and the hash of its literal."""
        if len(self.known) > CACHE // 2:
            self.clear()
        find, add = self.known.get, self.add
        at = np.array([k if (k := find(w)) is not None else add(w) for w in words], "i8")
        kind, opens = self.k[at], np.ones(len(at), "?")
        opens[1:] = self.s[at[:-1]]
        kind[(kind == CAP) & opens] = LIT
        behind = np.zeros(len(at), "?")
        behind[1:] = self.k[at[:-1]] == NUM
        kind[(kind == UNIT) & ~behind] = LIT
        out, plain = self.h[at], self.h[at]
        for k, h in self.marks.items():
            out[kind == k] = h
        return out, kind, plain

    def windows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and hash of the windows with enough literals, and the kinds and literals' hashes of all words."""
        hashes, kind, plain = self.canonical(words)
        span = min(SPAN, len(words))
        n = len(words) - span + 1
        rolled = np.zeros(n, "u8")
        for j in range(span):
            rolled += hashes[j : j + n] * STEP[j]
        rolled ^= rolled >> np.uint64(29)
        literal = np.concatenate([[0], np.cumsum(kind == LIT)])
        start = np.nonzero(literal[span:] - literal[:-span] >= min(LITERAL, span))[0]
        return start, rolled[start], kind, plain

    def named_start(self, words: list[str], kind: np.ndarray) -> tuple[int, np.ndarray] | None:
        """Hash and kinds of the first window of a text of SPAN to LEAST words, its first word read as a name; None if it cannot be one."""
        if not SPAN <= len(words) <= LEAST or kind[0] != LIT or self.k[self.known[words[0]]] != CAP:
            return None
        part = kind[:SPAN].copy()
        part[0] = CAP
        if (part == LIT).sum() < LITERAL:
            return None
        h = np.array([self.marks[k] if k else self.h[self.known[w]] for w, k in zip(words, part.tolist(), strict=False)], "u8")
        rolled = (h * STEP[:SPAN]).sum(dtype="u8")
        return int((rolled ^ (rolled >> np.uint64(29))).view("i8")), part


def runs(plain: np.ndarray, lengths) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the runs of exact words of each length that there is room for."""
    rolled, m = np.zeros(len(plain), "u8"), 0
    for length in sorted(lengths):
        if length > len(plain):
            return
        rolled = rolled[: len(plain) - length + 1].copy()
        while m < length:
            rolled += plain[m : m + len(rolled)] * STEP[m]
            m += 1
        yield length, (rolled ^ (rolled >> np.uint64(29))) + np.uint64(EXACT * length % (1 << 64))


def words_of_worker() -> Words:
    return common.worker_table("decontaminate", Words)


def canon(words: list[str], kinds) -> list[str]:
    return [MARK[k] if k else (w.strip(OUTER) or w).lower() for w, k in zip(words, kinds.tolist(), strict=True)]


HITS = "owner long, side long, h long, exact boolean, pos int, size int, canon array<string>, slots array<string>"


def hits(texts: DataFrame, bitmap=None, lengths=()) -> DataFrame:
    """owner, side, h, exact, pos, size (words of the text), canonical words and placeholders' values of windows that the bitmap has.

    texts has text and its key: owner and side (long).  Exact runs have the given lengths; without a bitmap (items), their own.
    """
    common.ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = words_of_worker(), []
        bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, "u1"))

        def batch():
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["owner", "side", "h", "exact", "pos", "size", "canon", "slots"]
        for b in common.sliced(batches):
            for owner, side, text in zip(*(b.column(c).to_pylist() for c in ("owner", "side", "text")), strict=True):
                words = (text or "").split()
                if not words:
                    continue
                start, rolled, kind, plain = known.windows(words)

                def window(p, h, k, owner=owner, side=side, words=words):
                    part = words[p : p + SPAN]
                    found.append((owner, side, h, False, p, len(words), canon(part, k), [w.strip(OUTER) or w if x else None for w, x in zip(part, k.tolist(), strict=True)]))

                if bits is not None:
                    keep = bits[(rolled % np.uint64(BITS)).astype("i8")] == 1
                    start, rolled = start[keep], rolled[keep]
                elif (named := known.named_start(words, kind)) is not None:
                    window(0, *named)
                for p, h in zip(start.tolist(), rolled.view("i8").tolist(), strict=True):
                    window(p, h, kind[p : p + SPAN])
                own = lengths if bits is not None else [min(len(words), LEAST)] if len(words) >= SHORT else []
                for m, hashes in runs(plain, own):
                    if bits is not None:
                        at = np.nonzero(bits[(hashes % np.uint64(BITS)).astype("i8")])[0]
                    else:
                        seen = np.zeros(len(words) + 1, "i8")
                        seen[1:][(start[:, None] + np.arange(min(SPAN, len(words)))).ravel()] = 1
                        seen = seen.cumsum()
                        at = np.arange(len(hashes)) if len(words) <= LEAST else np.nonzero(seen[m:] - seen[:-m] < m)[0]
                    for p in at.tolist():
                        found.append((owner, side, int(hashes[p].view("i8")), True, p, len(words), [(w.strip(OUTER) or w).lower() for w in words[p : p + m]], [None] * m))
                if len(found) > 5000:
                    yield batch()
                    found.clear()
        if found:
            yield batch()

    return texts.select("owner", "side", "text").mapInArrow(run, HITS)


def bitmap_of(windows: DataFrame) -> bytes:
    """Bits of all windows' hashes: partial bitmaps of fixed size are joined on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, "u1")
        for b in batches:
            bits[(b.column("h").to_numpy().view("u8") % np.uint64(BITS)).astype("i8")] = 1
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(BITS // 8, "u1")
    for row in windows.select("h").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(row.bits), "u1")
    return out.tobytes()


def runs_of(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of the items' windows own (item, h, exact, ipos, isize, icanon, islots).

    Returns the runs' windows, each once (run, off, h, exact, icanon, islots), and where the runs stand (run, item, start, isize, exact, shut: the offsets
    whose windows do not open a pair).  A window follows another in a run if it follows it in all places of either.
    """
    windows = own.withColumn("w", F.struct("h", "exact", F.xxhash64("icanon", "islots").alias("v")))
    order = Window.partitionBy("item", "exact").orderBy("ipos", "w")  # an item's windows
    step = (F.col("ipos") - F.lag("ipos").over(order)).alias("step")
    after = windows.select("item", "ipos", "w", F.lag("w").over(order).alias("before"), step)
    n = common.spool(windows.groupBy("w").agg(F.count("*").alias("n")), "places")
    both = after.where("before is not null").groupBy("before", "w", "step").agg(F.count("*").alias("c"))
    both = both.join(n, "w").where("c = n").drop("n").join(n.withColumnRenamed("w", "before"), "before").where("c = n")
    windows = windows.join(common.small(common.spool(both.select("w", F.lit(False).alias("first")), "links"), RUNS), "w", "left").withColumn("first", F.coalesce("first", F.lit(True)))
    part = F.sum(F.col("first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = windows.withColumn("part", part).groupBy("item", "exact", "part").agg(F.min(F.struct("ipos", "w")).alias("head"), F.max("isize").alias("isize"), F.collect_list(F.struct("ipos", "h", "icanon", "islots")).alias("list"))
    placed = common.spool(placed.select("item", "exact", "isize", F.col("head.w").alias("run"), F.col("head.ipos").alias("start"), "list"), "placed")
    # Of an item: its windows that others have too, most shared first, while they cover too little to count.
    shared = own.where("not exact").select("item", "h").distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    common_ones = own.where("not exact").join(shared, "h").groupBy("item").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "ipos", F.size("icanon").alias("m")))).alias("list"), F.max("isize").alias("isize"))
    nothing = F.array().cast("array<int>")

    def take(acc, x):
        covered = F.array_union(acc["covered"], F.sequence(x["ipos"], x["ipos"] + x["m"] - 1))
        fits = ~acc["full"] & (F.size(covered) < F.least(F.col("isize"), F.lit(LEAST)))
        return F.when(fits, F.struct(covered.alias("covered"), F.array_append(acc["shut"], x["ipos"]).alias("shut"), F.lit(False).alias("full"))).otherwise(F.struct(acc["covered"].alias("covered"), acc["shut"].alias("shut"), F.lit(True).alias("full")))

    start = F.struct(nothing.alias("covered"), nothing.alias("shut"), F.lit(False).alias("full"))
    shut = common_ones.select("item", F.array_distinct(F.aggregate("list", start, take)["shut"]).alias("shut"))
    members = placed.join(shut, "item", "left").select("run", "item", "start", "isize", "exact", F.when(F.col("exact"), nothing).otherwise(F.transform(F.coalesce("shut", nothing), lambda p: p - F.col("start"))).alias("shut"))
    once = placed.groupBy("run").agg(F.first(F.struct("start", "list")).alias("x")).select("run", "x.start", F.explode("x.list").alias("w"))
    once = once.select("run", (F.col("w.ipos") - F.col("start")).alias("off"), "w.h", F.col("run.exact").alias("exact"), "w.icanon", "w.islots")
    return common.spool(once, "runs"), common.spool(members, "members")


def met(found: DataFrame, runs: DataFrame) -> DataFrame:
    """owner, side, run, line (position in the text less that in the run), offs (matched windows), at (words, from the run's start), pairs (values), same; spooled.

    A window that is common in the corpus is joined by broadcast where the runs are counted to be few, else in parts.
    """
    if runs.count() <= RUNS:
        both = found.join(F.broadcast(runs), ["h", "exact"])
    else:
        salt = F.pmod(F.xxhash64("owner", "side", "pos"), F.lit(SALTS)).cast("int")
        both = found.withColumn("salt", salt).join(runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "exact", "salt"])
    pairs = F.filter(F.arrays_zip(F.col("islots").alias("a"), F.col("slots").alias("b")), lambda x: x["a"].isNotNull())
    at = F.sequence("off", F.col("off") + F.size("icanon") - 1)
    same = F.when(F.forall("pairs", lambda x: x["a"] == x["b"]), F.col("at"))
    windows = both.where(F.col("canon") == F.col("icanon")).select("owner", "side", "run", "off", (F.col("pos") - F.col("off")).alias("line"), at.alias("at"), pairs.alias("pairs"))
    lines = windows.groupBy("owner", "side", "run", "line").agg(F.collect_set("off").alias("offs"), *(F.array_distinct(F.flatten(F.collect_list(c))).alias(n) for c, n in (("at", "at"), ("pairs", "pairs"), (same, "same"))))
    return common.spool(lines, "met")


def handed_on(lines: DataFrame, members: DataFrame) -> DataFrame:
    """What texts meet of runs, for the items that hold them, of all pairs that a window opens."""
    opens = F.size(F.array_except("offs", "shut")) > 0
    if members.where(F.size("shut") > 0).isEmpty():
        return lines.join(common.small(members, RUNS), "run")
    pairs = lines.select("owner", "side", "run", "offs").join(common.small(members, RUNS), "run").where(opens).select("owner", "side", "item").distinct()
    near = common.spool(pairs, "pairs")
    return near.join(common.small(members, RUNS), "item").join(lines, ["owner", "side", "run"])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """owner, side, item_id, words (of the item, covered): contamination of docs (owner, side, text) by benchmark (item_id, text)."""
    ids = common.spool(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    items = common.spool(hits(ids.select(F.col("item").alias("owner"), F.lit(0).cast("long").alias("side"), "text")), "windows")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(items))
    own = items.select(F.col("owner").alias("item"), "h", "exact", F.col("pos").alias("ipos"), F.col("size").alias("isize"), F.col("canon").alias("icanon"), F.col("slots").alias("islots"))
    lengths = [r.n for r in items.where("exact").select(F.size("canon").alias("n")).distinct().collect()]  # at most LEAST
    runs, members = runs_of(own)
    held = handed_on(met(hits(docs, bitmap, lengths), runs), members)
    moved = lambda c: F.transform(c, lambda p: p + F.col("start"))
    windows = held.select("owner", "side", "item", "isize", "exact", (F.col("line") - F.col("start")).alias("diagonal"), moved("at").alias("at"), "pairs", moved("same").alias("same"))
    lines = windows.groupBy("owner", "side", "item", "isize", "exact", "diagonal").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("at", "pairs", "same")))
    order = Window.partitionBy("owner", "side", "item", "exact").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    line = F.struct((-F.size("at")).alias("rank"), "diagonal", "at", "pairs")
    places = lines.withColumn("place", F.sum(fresh.cast("int")).over(order)).groupBy("owner", "side", "item", "isize", "exact", "place").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.size(F.array_distinct(F.flatten(F.collect_list("same")))).alias("same"))

    def take(a, x):
        merged = F.array_union(a["pairs"], x["pairs"])
        agrees = F.size(F.array_distinct(F.transform(merged, lambda y: y["a"]))) == F.size(merged)
        return F.when(agrees, F.struct(F.array_union(a["at"], x["at"]).alias("at"), merged.alias("pairs"))).otherwise(a)

    start = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<struct<a:string,b:string>>").alias("pairs"))
    n = F.greatest(F.size(F.aggregate("lines", start, take)["at"]), F.col("same"))
    good = places.withColumn("n", n).where(F.col("n") >= F.least(F.col("isize"), F.lit(LEAST)))
    return good.groupBy("owner", "side", "item").agg(F.coalesce(F.max(F.when(~F.col("exact"), F.col("n"))), F.max("n")).alias("n")).join(ids.drop("text"), "item").select("owner", "side", "item_id", F.col("n").cast("long").alias("words"))


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with item_ids (sorted; empty if clean) and covered (words of the best covered item)."""
    for c in ("item_ids", "covered"):
        if c in docs.columns:
            raise ValueError(f"the input has a column {c} already")
    side = F.xxhash64("text")
    found = matches(docs.select(F.col("doc_id").alias("owner"), side.alias("side"), "text"), benchmark)
    found = common.spool(found.groupBy("owner", "side").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("words").alias("covered")), "leaks")
    leaks = found.select(F.col("owner").alias("_owner"), F.col("side").alias("_side"), F.col("item_ids").alias("_items"), F.col("covered").alias("_covered"))
    joined = docs.join(leaks, docs["doc_id"].eqNullSafe(F.col("_owner")) & (F.xxhash64(docs["text"]) == F.col("_side")), "left")
    return joined.select(*(docs[c] for c in docs.columns), F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("_covered", F.lit(0)).cast("long").alias("covered"))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, covered of every document."""
    marked = mark(common.spread(docs.select("doc_id", "text")), benchmark.select("item_id", "text"))
    return marked.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "covered")
