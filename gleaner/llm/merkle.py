"""Merkle manifest of a dataset, from contiguous digest matrices.

Every row is a leaf: the SHA-256 of its fields, each as its length in bytes, a colon and its value (`-` for null).  Rows of one
tree (a value of the column tree, null being one of its own) stand in order of key (null first) and leaf; level by level, every
fanout consecutive nodes become the hash of their hexadecimal digests (the last run has fewer, even one), until one is left:
the subroot.  The subroots, null first and then in order of bytes, make a tree of their own, whose root stands for the dataset.

Positions come from ranges (see ranks).  Aligned blocks of up to BLOCK nodes are packed into rows; a task sees a block as a matrix of 64
bytes a node, reshapes it by the fanout and hashes its rows level by level, and the tops of the blocks are the nodes of the next
pass.  A pass divides the number of nodes by the block, so there are few (five for 30 thousand million leaves).  On the way down
every block gets the siblings above it; inside it, siblings are found by index arithmetic.  No tree is gathered: a task holds
blocks, the driver the root.

Rows equal in key and leaf stand side by side; repeated keys are leaves each.  A null text or number is a field `-`, unlike an empty text
(`0:`).  Texts are hashed whole.  An empty table has no root and gives no rows; further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ranks

BLOCK = 256  #: most nodes in a block
BROADCAST = 10_000  #: rows of paths (about 1 KB each) that may be broadcast
HEX = np.frombuffer(b"0123456789abcdef", "u1")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(values: list[Column]) -> Column:
    """SHA-256, binary, of the fields; numbers in decimal."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(digests: list[bytes]) -> np.ndarray:
    """The matrix (n, 64) of digests in hexadecimal letters."""
    raw = np.frombuffer(b"".join(digests), "u1").reshape(-1, 32)
    return np.stack([HEX[raw >> 4], HEX[raw & 15]], -1).reshape(-1, 64)


def level(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level of a matrix (n, 64): hashes of rows of fanout nodes; the last row may have fewer."""
    whole = len(nodes) // fanout * fanout
    tops = [sha256(row).hexdigest() for row in nodes[:whole].reshape(-1, fanout * 64)]
    if whole < len(nodes):
        tops.append(sha256(nodes[whole:].tobytes()).hexdigest())
    return np.frombuffer("".join(tops).encode(), "u1").reshape(-1, 64)


def height(total: int, fanout: int, most: int) -> int:
    """Levels to climb inside a block of a tree with so many nodes: until one is left, or most."""
    k = 0
    while total > 1 and k < most:
        total, k = -(-total // fanout), k + 1
    return k


def block_levels(fanout: int) -> int:
    """Levels of a full block."""
    if fanout < 2 or fanout > 255:
        raise ValueError("the fanout is from 2 to 255")
    k = 1
    while fanout ** (k + 1) <= BLOCK:
        k += 1
    return k


def ladder(nodes: np.ndarray, steps: int, fanout: int) -> list[np.ndarray]:
    out = [nodes]
    for _ in range(steps):
        out.append(level(out[-1], fanout))
    return out


def siblings(rungs: list[np.ndarray], fanout: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of every node of the lowest level, going up: the other nodes of its runs, left to right.

    Returns their digests one behind the other, how many there are (node, level), and how many of these stand left of it.
    """
    n, steps = len(rungs[0]), len(rungs) - 1
    at = np.arange(n)
    places, valid = np.zeros((n, steps, fanout, 64), "u1"), np.zeros((n, steps, fanout), "?")
    left = np.zeros((n, steps), "i8")
    for k, rung in enumerate(rungs[:-1]):
        own = at // fanout**k
        left[:, k] = own % fanout
        run = (own - left[:, k])[:, None] + np.arange(fanout)
        valid[:, k] = (run != own[:, None]) & (run < len(rung))
        places[:, k] = rung[np.minimum(run, len(rung) - 1)]
    return places[valid].tobytes(), valid.sum(2), left


def climb(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """Fold a digest (hexadecimal) with its siblings, left and right of it, level by level."""
    for a, b in path:
        digest = sha256(a + digest + b).hexdigest().encode()
    return digest


def packed_path(path: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(bytes((len(a) // 64, len(b) // 64)) + a + b for a, b in path)


def unpacked_path(data: bytes) -> list[tuple[bytes, bytes]]:
    out, p = [], 0
    while p < len(data):
        a, b = data[p] * 64, data[p + 1] * 64
        out.append((data[p + 2 : p + 2 + a], data[p + 2 + a : p + 2 + a + b]))
        p += 2 + a + b
    return out


def local_paths(rungs: list[np.ndarray], fanout: int) -> Iterator[tuple[bytes, list[tuple[bytes, bytes]]]]:
    """Of every node of a block: all its siblings inside it, and the same as pairs (left, right) by level."""
    data, count, left = siblings(rungs, fanout)
    p = 0
    for counts, lefts in zip(count.tolist(), left.tolist(), strict=True):
        start, path = p, []
        for c, k in zip(counts, lefts, strict=True):
            path.append((data[p : p + 64 * k], data[p + 64 * k : p + 64 * c]))
            p += 64 * c
        yield data[start:p], path


def pack(nodes: DataFrame, span: int, *payload: str) -> DataFrame:
    """tree, block, total (nodes of the tree), nodes (pos, digest, payload; by pos): aligned blocks as rows, spooled."""
    block = F.floor(F.col("pos") / F.lit(span)).cast("long").alias("block")
    rows = nodes.groupBy("tree", block).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "digest", *payload))).alias("nodes"))
    return common.spool(rows, "blocks")


def lists(column: pa.ListArray) -> Iterator[list[list]]:
    """Of every row of a list of structs: the structs' fields, each as a Python list."""
    fields = [f.to_pylist() for f in column.flatten().flatten()]
    at = 0
    for n in column.value_lengths().to_pylist():
        yield [f[at : at + n] for f in fields]
        at += n


def up(blocks: DataFrame, fanout: int) -> DataFrame:
    """The blocks' tops as nodes of the next pass: tree, pos, total, digest."""
    most = block_levels(fanout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            totals, tops = b.column("total").to_pylist(), []
            for total, (_, digests, *_) in zip(totals, lists(b.column("nodes")), strict=True):
                tops.append(bytes.fromhex(ladder(hexed(digests), height(total, fanout, most), fanout)[-1].tobytes().decode()))
            next_totals = [-(-t // fanout**most) for t in totals]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), pa.array(next_totals, pa.int64()), pa.array(tops, pa.binary())], ["tree", "pos", "total", "digest"])

    return common.spool(blocks.mapInArrow(run, "tree string, pos long, total long, digest binary"), "tops")


def grow(nodes: DataFrame, fanout: int, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """All passes over nodes (tree, pos, total, digest, payload): the packed blocks of each, and tree, digest of the roots."""
    span, levels, roots = fanout ** block_levels(fanout), [], []
    while True:
        levels.append(pack(nodes, span, *(payload if not levels else ())))
        tops = up(levels[-1], fanout)
        roots.append(tops.where("total = 1").select("tree", "digest"))
        nodes = tops.where("total > 1")
        if nodes.isEmpty():
            break
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def with_paths(blocks: DataFrame, tops: DataFrame, above: DataFrame | None, span: int) -> DataFrame:
    """Blocks with the path above them and their tree's subroot: those that end their tree from tops (tree, path, subroot), others from above."""
    last = blocks.where(F.col("total") <= span).join(common.small(tops, BROADCAST), "tree")
    if above is None:
        return last
    inner = blocks.where(F.col("total") > span).join(common.small(above.withColumnRenamed("pos", "block"), BROADCAST), ["tree", "block"])
    return last.unionByName(inner)


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The lowest blocks with their paths, from tops (tree, path, subroot): every pass gives its nodes the siblings above them."""
    most, above = block_levels(fanout), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            rows = []
            for tree, total, path, subroot, (pos, digests, *_) in zip(*(b.column(c).to_pylist() for c in ("tree", "total", "path", "subroot")), lists(b.column("nodes")), strict=True):
                rungs = ladder(hexed(digests), height(total, fanout, most), fanout)
                for p, (_, own) in zip(pos, local_paths(rungs, fanout), strict=True):
                    rows.append((tree, p, packed_path(own) + path, subroot))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["tree", "pos", "path", "subroot"])

    for blocks in reversed(levels[1:]):
        found = with_paths(blocks, tops, above, fanout**most)
        above = common.spool(found.mapInArrow(run, "tree string, pos long, path binary, subroot string"), "paths")
    return with_paths(levels[0], tops, above, fanout**most)


PROOF = "key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(blocks: DataFrame, root: str, fanout: int, kind: str) -> DataFrame:
    """A row a leaf: its proof's hash, and the root that its changed form (where there is one) folds to."""
    most = block_levels(fanout)
    schema = PROOF.format(kind=kind)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            rows, keys = [], b.column("nodes").flatten().flatten()[2]
            for total, above, subroot, (_, digests, _, changed) in zip(*(b.column(c).to_pylist() for c in ("total", "path", "subroot")), lists(b.column("nodes")), strict=True):
                nodes = hexed(digests)
                upper = unpacked_path(above)
                rest = b"".join(x for pair in upper for x in pair)
                folded: dict[bytes, str] = {}  # tops of the block: nearly all leaves fold to the same
                for node, other, (proof, own) in zip(nodes, changed, local_paths(ladder(nodes, height(total, fanout, most), fanout), fanout), strict=True):
                    leaf = node.tobytes()
                    top = climb(leaf if other is None else other.hex().encode(), own)
                    if top not in folded:
                        folded[top] = climb(top, upper).decode()
                    rows.append((leaf.decode(), subroot, root, sha256(proof + rest).hexdigest(), folded[top], folded[top] == root))
            if rows:
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, zip(*rows, strict=True))], names)

    return blocks.mapInArrow(run, schema)


def manifest(docs: DataFrame, key: str, tree: str, leaf: Column, changed: Column, fanout: int = 2) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    leaf is its digest (binary); changed is that of a tampered form, null where the row is as it was: it is folded with the original siblings.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    name = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0"))  # ordered as the trees are: null first, then bytes
    leaves = docs.select(name.alias("tree"), F.col(key).alias("key"), leaf.alias("digest"), changed.alias("changed"))
    placed = ranks.numbered(ranks.dealt(leaves, ["tree", "key", "digest"], "leaves"), ["tree"], "pos", "total")
    levels, subroots = grow(placed, fanout, "key", "changed")
    subroots = common.spool(subroots.withColumnRenamed("tree", "name"), "subroots")
    trees = ranks.numbered(ranks.dealt(subroots.withColumn("tree", F.lit("")), ["tree", "name"], "trees"), ["tree"], "pos", "total")
    over, roots = grow(trees, fanout, "name")
    top = roots.first()
    if top is None:
        return spark.createDataFrame([], PROOF.format(kind=kind)).withColumnRenamed("key", key)
    root = top.digest.hex()
    whole = spark.createDataFrame([("", b"", root)], "tree string, path binary, subroot string")
    tops = common.spool(named_paths(descend(over, whole, fanout), fanout), "tops")
    return prove(descend(levels, tops, fanout), root, fanout, kind).withColumnRenamed("key", key)


def named_paths(blocks: DataFrame, fanout: int) -> DataFrame:
    """tree, path, subroot: of every subroot its way to the root."""
    most = block_levels(fanout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            rows = []
            for total, path, (_, digests, names) in zip(*(b.column(c).to_pylist() for c in ("total", "path")), lists(b.column("nodes")), strict=True):
                nodes = hexed(digests)
                for name, node, (_, own) in zip(names, nodes, local_paths(ladder(nodes, height(total, fanout, most), fanout), fanout), strict=True):
                    rows.append((name, packed_path(own) + path, node.tobytes().decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)], ["tree", "path", "subroot"])

    return blocks.mapInArrow(run, "tree string, path binary, subroot string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, by lang and with fanout 2.

    Where 7 divides the CRC-32 of the decimal doc_id, the tampered form has one more in n_chars.
    """
    fields = [F.col(c) for c in FIELDS]
    more = [F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return manifest(common.spread(docs.select(*FIELDS)), "doc_id", "lang", leaf_of(fields), F.when(hit, leaf_of(more)))
