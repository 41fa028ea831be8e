"""Exact Jaccard join of documents on word n-grams, by prefixes of token combinations, and its connected components.

A token is an n-gram (shingle) of a document's set.  Tokens are ordered rarest first by a count sketch over all documents.
Two sets that link share a token within their prefixes of n - minimum overlap + 1 tokens.  A prefix that holds a frequent
token is extended by CLASSES tokens: it then shares CLASSES + 1 tokens with any partner, so either a rare one or, by the
pigeonhole principle, two frequent ones of the same class.  Rare tokens are indexed singly, frequent ones as pairs within
their class.  Sets too small for the extension index all tokens of the plain prefix singly; sets just above do both.

Copies (equal sets) are one node, named by their smallest doc_id.  Of lists with the same members (a passage's signatures) one
stays.  No list of a signature's members is expanded into all its
pairs: first a list elects its commonest text, in round r some GROWTH ** r members that are not in its pivot's component (both by
hash), and all members of other components are compared with these centres.  Centres leave the list, and a list goes when all
that is left of it is one component.  Members take their sizes and the parities of their tokens by hash bit along, and pairs are
made only where two exact bounds on these allow a link (each bit in which two parities differ is a token that only one of them
has).  Whole sets decide, so the result is exact.

Defined results: a document without words has an empty set and links with nothing; a null doc_id has n_shingles and a null
component_id and links with nothing; rows that repeat a doc_id are one document with several texts.  An empty table gives no
rows.  Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNKS, CHUNK = 64, 1 << 16
CELLS = CHUNKS * CHUNK  #: cells of the count sketch, whatever the corpus
CLASSES = 16
GROWTH = 16  #: centres of a list, from round to round
PART = 2048  #: members of a long list that meet its centres in one task
PARITY = 256  #: bits of the parity that every node has; sets of more tokens have a longer one besides
CARRIED = 256  #: longs of a longer parity that is taken along in lists; beyond, it is compared after pairs are made
OWN = 32  #: least signatures of its lists that a member takes along, so that a pair is made in one list of those that it shares
MANY = 4096  #: copies of a text from which on its component is looked up in a broadcast table (of at most a row in MANY)
BITS = 1 << 20, 1 << 27  #: least and most bits of a bitmap
MIX = np.uint64(0x9E3779B97F4A7C15)


class Job:
    """Parameters: words in a shingle, similarity in hundredths, least count of a frequent token."""

    def __init__(self, words: int, percent: int, floor: int = 256):
        self.words, self.percent, self.floor = words, percent, floor
        small = 1
        while self.overlap(small + 1) <= CLASSES:
            small += 1
        self.small, self.both = small, small * 100 // percent

    def overlap(self, n: int) -> int:
        """Least size of the intersection of a set of n with any it links to."""
        return -(-self.percent * n // 100)

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct shingles; with fewer words, of the whole sequence as one."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, "u8")
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, "u8")
        for j in range(k):
            out = out * MIX + h[j : j + len(out)]
            out ^= out >> np.uint64(31)
        return np.unique(out)

    def signatures(self, s: np.ndarray, counts: np.ndarray, frequent: int) -> np.ndarray:
        """Signatures of a set, given its tokens' counts in the sketch."""
        n = len(s)
        order = np.lexsort((s, counts))
        plain = n - self.overlap(n) + 1
        first = s[order[:plain]]
        if n <= self.small or counts[order[plain - 1]] <= frequent:
            return first
        wide = order[: min(n, plain + CLASSES)]
        rare, often = s[wide[counts[wide] <= frequent]], s[wide[counts[wide] > frequent]]
        parts = [rare] if n > self.both else [rare, first]
        kind = (often >> np.uint64(7)) % np.uint64(CLASSES)
        for c in range(CLASSES):
            own = np.sort(often[kind == c])
            i, j = np.triu_indices(len(own), 1)
            pairs = (own[i] * MIX + own[j]) * MIX
            parts.append(pairs ^ pairs >> np.uint64(32))
        return np.unique(np.concatenate(parts))


def cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(42)).astype("i8")


def set_id(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)


def profile(docs: DataFrame, job: Job) -> DataFrame:
    """doc_id, n, a, b (128-bit id of the set) of every document; and, with chunk, a task's part of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_table("jaccard_join")
        sketch = np.zeros(CELLS, "i4")
        for b in common.sliced(batches):
            rows = []
            for text in b.column("text").to_pylist():
                s = job.shingles(text)
                np.add.at(sketch, cell(s), 1)
                rows.append((len(s), *set_id(s)))
            n, x, y = zip(*rows, strict=True)
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), *none], names)
        for k in np.nonzero(sketch.reshape(CHUNKS, CHUNK).any(1))[0].tolist():
            part = zlib.compress(sketch[k * CHUNK : (k + 1) * CHUNK].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([k], pa.int32()), pa.array([part], pa.binary())], names)

    names = ["doc_id", "n", "a", "b", "chunk", "part"]
    return common.spool(docs.mapInArrow(run, "doc_id long, n long, a long, b long, chunk int, part binary"), "profile")


def sketch_of(profiled: DataFrame) -> np.ndarray:
    """Sum of the parts: tasks add up chunks as they stream by; the result has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("chunk").to_pylist(), b.column("part"), strict=True):
                values = np.frombuffer(zlib.decompress(part.as_py()), "i4")
                sums[k] = sums[k] + values if k in sums else values.astype("i8")
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "part": [np.minimum(v, 2**31 - 1).astype("i4").tobytes()]})

    out = np.zeros((CHUNKS, CHUNK), "i4")
    for r in profiled.where("chunk is not null").select("chunk", "part").repartition(CHUNKS // 4, "chunk").mapInArrow(run, "chunk int, part binary").collect():
        out[r.chunk] = np.frombuffer(bytes(r.part), "i4")
    return out.reshape(-1)


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """Bits of hashed values of a spooled long column, 16 for each up to a limit: lets all of them, and some others, through."""
    size = min(BITS[1], max(BITS[0], 1 << (16 * ids.count()).bit_length()))

    chunk = size // 8 // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, "u1")
        for b in batches:
            at = bit(b.column(0).to_numpy().view("u8"), size)
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype("u1"))
        for k in np.nonzero(bits.reshape(CHUNKS, chunk).any(1))[0].tolist():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "bits": [zlib.compress(bits[k * chunk : (k + 1) * chunk].tobytes(), 1)]})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("chunk").to_pylist(), b.column("bits"), strict=True):
                values = np.frombuffer(zlib.decompress(part.as_py()), "u1")
                sums[k] = sums[k] | values if k in sums else values
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "bits": [zlib.compress(v.tobytes(), 1)]})

    out = np.zeros((CHUNKS, chunk), "u1")
    schema = "chunk int, bits binary"
    for r in ids.mapInArrow(run, schema).repartition(CHUNKS // 4, "chunk").mapInArrow(joined, schema).collect():  # one bitmap
        out[r.chunk] = np.frombuffer(zlib.decompress(bytes(r.bits)), "u1")
    return out.reshape(-1)


def bit(values: np.ndarray, size: int) -> np.ndarray:
    return ((values * MIX) >> np.uint64(32)).astype("i8") & (size - 1)


def has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the bitmap lets through."""
    at = bit(values, 8 * len(bits))
    return bits[at >> 3] >> (7 - (at & 7)).astype("u1") & 1 == 1


def parity(s: np.ndarray, size: int) -> np.ndarray:
    """Parity of the tokens in each of size bits, as longs; XOR of its halves is the parity in half as many bits."""
    at = (s >> np.uint64(20)).astype("i8") & (size - 1)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype("u1"), bitorder="little").view("<i8")


def held(df: DataFrame, column: str, bits) -> DataFrame:
    """Rows whose long column the broadcast bitmap lets through, before they are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(has(bits.value, b.column(column).to_numpy(zero_copy_only=False).view("u8"))))

    return df.mapInArrow(run, df.schema)


FOLDED = [f"f{j}" for j in range(PARITY // 64)]


def signature_rows(docs: DataFrame, job: Job, shared) -> DataFrame:
    """sig, a of every document's signatures; and, with sig null, its node: doc_id, a, b, n, rank (prefers common texts), parities."""
    schema = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("doc_id", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("rank", pa.int32()), *((f, pa.int64()) for f in FOLDED), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, frequent = shared.value
        for b in common.sliced(batches):
            parts, nodes = [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = job.shingles(text)
                if len(s):
                    counts, (x, y) = sketch[cell(s)], set_id(s)
                    sig = job.signatures(s, counts, frequent)
                    parts.append((sig, np.full(len(sig), x, "i8")))
                    longer = parity(s, 1 << len(s).bit_length()).tolist() if len(s) > PARITY else None
                    nodes.append((None, x, doc_id, y, len(s), int(np.log2(1 + counts).mean() * 128), *parity(s, PARITY).tolist(), longer))
            if parts:
                sig, a = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view("i8")), pa.array(a), *(pa.nulls(len(a), f.type) for f in list(schema)[2:])], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, f"sig long, a long, doc_id long, b long, n long, rank int, {', '.join(f'{f} long' for f in FOLDED)}, bits array<long>")


def set_rows(docs: DataFrame, job: Job, wanted) -> DataFrame:
    """doc_id, a, tokens of the documents whose doc_id the bitmap lets through; dealt by these, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            b = b.filter(pa.array(has(wanted.value, b.column("doc_id").to_numpy().view("u8"))))
            if b.num_rows:
                sets = [job.shingles(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([set_id(s)[0] for s in sets]), pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))], ["doc_id", "a", "tokens"])

    return docs.mapInArrow(run, "doc_id long, a long, tokens array<long>").repartition("doc_id", "a").dropDuplicates(["doc_id", "a"])


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of all nodes of edges (u, v), spooled: labels spread and jump until none changes."""
    both = common.spool(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = common.spool(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        far = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = common.spool(stepped.join(far, "mid").select("node", F.least("mid", "far").alias("label"), "old"), "labels")
        common.drop(labels)
        labels = new
        if labels.where("label <> old").isEmpty():
            common.drop(both)
            return labels


class Links:
    """Links between representatives, enough to connect every component; reps: a, b, doc_id, node (a number)."""

    def __init__(self, docs: DataFrame, profiled: DataFrame, reps: DataFrame, job: Job):
        self.docs, self.job, self.spark = docs, job, docs.sparkSession
        sketch = sketch_of(profiled)
        shared = self.share((sketch, max(job.floor, int(8 * sketch.mean()))))
        rows = common.spool(signature_rows(docs, job, shared), "signatures")
        shared.unpersist()
        del sketch, shared
        common.trim()
        signed = rows.where("sig is not null").select("sig", "a")
        # Only signatures of two different sets matter.
        lists = common.spool(signed.groupBy("sig").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("sig"), "lists")
        self.nodes = common.spool(rows.where("sig is null").drop("sig").join(reps, ["doc_id", "a", "b"]).dropDuplicates(["doc_id", "a", "b"]), "nodes")
        members = held(signed, "sig", self.share(bitmap_of(lists))).distinct().join(lists, "sig")
        members = common.spool(members.join(self.nodes.select("a", "node", "n", "rank"), "a").select("sig", "node", "n", "rank", F.col("node").alias("label")), "members")
        common.drop(rows, lists)
        first = self.listed(members, F.max(F.struct("rank", "node"))["node"], F.expr("node = top"))
        # Members take their parities along, so that these prune pairs inside the join.
        carried = F.when(F.size("bits") <= CARRIED, F.col("bits")).alias("bits")
        own = first.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, OWN).alias("own"))
        self.alive = common.spool(first.join(self.nodes.select("node", *FOLDED, carried), "node").join(own, "node"), "alive")
        common.drop(members, first)
        self.made = [self.nodes, self.alive]

    def share(self, value):
        return self.spark.sparkContext.broadcast(value)

    def listed(self, members: DataFrame, top, centre) -> DataFrame:
        """Members of the lists that span components, with m (members of the list) and whether they are a centre.

        Of lists with the same members, told by 128 bits of their nodes' hashes, that of the least signature stays.
        """
        which = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"set{k}") for k in (0, 1)]
        stats = members.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), top.alias("top"), *which).where("low <> high")
        stats = stats.groupBy("set0", "set1", "m").agg(F.min(F.struct("sig", "top")).alias("kept")).select("kept.*", "m")
        return common.spool(members.join(stats.select("sig", "m", "top"), "sig").withColumn("centre", centre).drop("top", "rank"), "alive")

    def near(self, more: str = "true") -> str:
        """SQL: the sizes of x and y, and the parities that both have, allow a link; and more, which is tried before the longer parities."""
        p, differ = self.job.percent, " + ".join(f"bit_count(x{f} ^ y{f})" for f in FOLDED)
        # Longer parities of unequal length: the longer one is folded to half.
        halved = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (p, q) -> p ^ q)"
        longer = "if(size({0}) > size({1}), " + halved + ", {0})"
        apart = f"aggregate(zip_with({longer.format('xbits', 'ybits')}, {longer.format('ybits', 'xbits')}, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"
        unlike = "xbits is null or ybits is null or size(xbits) > 2 * size(ybits) or size(ybits) > 2 * size(xbits)"
        most = f"(xn + yn) * {100 - p}"
        return f"100 * least(xn, yn) >= {p} * greatest(xn, yn) and ({differ}) * {100 + p} <= {most} and {more} and ({unlike} or {apart} * {100 + p} <= {most})"

    def met(self, alive: DataFrame) -> DataFrame:
        """x, y, xl, yl: nodes to compare, and their labels.

        A pair is passed over in a list where both members know a lesser signature that they share: it meets in that one's list,
        at the latest when this is down to the two, or in the list of a lesser signature that has the same members left.
        The members of a long list are dealt into parts by hash, and its centres go to each of these, so no task compares a whole list.
        """
        columns = ["node", "n", "label", *FOLDED, "bits", "own"]
        parts = F.ceil(F.col("m") / PART).cast("int")
        x = alive.where("centre").select("sig", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *(F.col(c).alias(f"x{c}") for c in columns))
        y = alive.select("sig", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "centre", *(F.col(c).alias(f"y{c}") for c in columns))
        once = "coalesce(array_min(array_intersect(xown, yown)) >= sig, true)"
        met = y.join(x, ["sig", "part"]).where(F.expr(f"xlabel <> ylabel and (not centre or xnode < ynode) and {self.near(once)}"))
        return met.select(F.col("xnode").alias("x"), F.col("ynode").alias("y"), F.col("xlabel").alias("xl"), F.col("ylabel").alias("yl"))

    def linked(self, pairs: DataFrame) -> DataFrame | None:
        """u, v: the labels of pairs that link, spooled; None without any."""
        columns = ["doc_id", "a", "n", *FOLDED, "bits"]
        x, y = (self.nodes.select(F.col("node").alias(k), *(F.col(c).alias(f"{k}{c}") for c in columns)) for k in "xy")
        p = self.job.percent
        close = pairs.join(x, "x").join(y, "y").where(F.expr(self.near()))
        close = common.spool(close.select("xdoc_id", "xa", "ydoc_id", "ya", "xl", "yl"), "close")
        if close.isEmpty():
            common.drop(close)
            return None
        ids = common.spool(close.select(F.col("xdoc_id").alias("doc_id")).union(close.select("ydoc_id")).distinct(), "wanted")
        sets = set_rows(self.docs, self.job, self.share(bitmap_of(ids)))
        x, y = (sets.select(F.col("doc_id").alias(f"{k}doc_id"), F.col("a").alias(f"{k}a"), F.col("tokens").alias(f"{k}s")) for k in "xy")
        both = close.join(x, ["xdoc_id", "xa"]).join(y, ["ydoc_id", "ya"]).withColumn("common", F.size(F.array_intersect("xs", "ys")).cast("long"))
        found = both.where(F.expr(f"100 * common >= {p} * (size(xs) + size(ys) - common)")).select(F.col("xl").alias("u"), F.col("yl").alias("v")).distinct()
        out = common.spool(found, "links")
        common.drop(close, ids)
        return None if out.isEmpty() else out

    def all(self) -> DataFrame:
        """u, v: linked nodes."""
        found, alive, turn = None, self.alive, 0
        while not alive.isEmpty():
            turn += 1
            edges, left, names = self.linked(self.met(alive).distinct()), alive.where("not centre").drop("m", "centre"), None
            if edges is not None:
                names = components(edges)
                left = left.join(names.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
                left = left.withColumn("label", F.coalesce("new", "label")).drop("new")
                found = edges if found is None else found.union(edges)
                self.made.append(edges)
            draw = f"xxhash64(sig, node, {turn})"
            chosen = F.expr(f"label <> top and pmod({draw}, {1 << 30}) * m < {GROWTH**turn} * {1 << 30}L")
            alive = self.listed(left, F.max_by("label", F.expr(draw)), chosen)
            self.made.append(alive)
            if names is not None:
                common.drop(names)
        return found if found is not None else self.nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)


def join(docs: DataFrame, words: int, percent: int, floor: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of docs (doc_id, text)."""
    common.ship(docs.sparkSession)
    job = Job(words, percent, floor)
    rows = common.spread(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")))
    profiled = profile(rows, job)
    own = profiled.where("chunk is null").drop("chunk", "part")
    sized = own.where("n > 0 and doc_id is not null")
    reps = sized.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    reps = common.spool(reps, "reps")
    # Copies share a representative; a doc_id of several texts ties their representatives together.
    several = sized.groupBy("doc_id").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("doc_id")
    ties = sized.join(several, "doc_id").select("doc_id", "a", "b").join(reps.select("a", "b", "node"), ["a", "b"]).select("doc_id", "node")
    ties = ties.join(ties.groupBy("doc_id").agg(F.min("node").alias("first")), "doc_id").select(F.col("first").alias("u"), F.col("node").alias("v"))
    links = Links(rows.where("doc_id is not null"), profiled, reps.drop("copies"), job)
    labels = components(links.all().union(ties))
    common.drop(*links.made)
    firsts = labels.join(reps, "node").groupBy("label").agg(F.min("doc_id").alias("first"))
    named = reps.join(labels.join(firsts, "label").select("node", "first"), "node", "left").select("a", "b", "copies", F.coalesce("first", "doc_id").alias("first"))
    hot = common.small(common.spool(named.where(f"copies > {MANY}").drop("copies"), "copied"))
    marked = sized.join(hot, ["a", "b"], "left")
    found = marked.where("first is not null").select("doc_id", "n", "first")
    found = found.union(marked.where("first is null").drop("first").join(named.where(f"copies <= {MANY}"), ["a", "b"]).select("doc_id", "n", "first"))
    rest = own.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("first"))
    return found.union(rest).select("doc_id", F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: four words, 85 hundredths."""
    return join(docs, 4, 85)
