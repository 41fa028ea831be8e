"""Prefix trie of conversations, encoded by preorder intervals.

A node is a distinct sequence of first turns (role, text).  Nodes get a place in preorder and the place where their subtree ends, so that
what a subtree adds up to (childless nodes, tokens saved by sharing) is a difference of two prefix sums.

Turns are numbered in their conversation by ranges (see ranks), and a prefix is named by the exclusive or of 128-bit hashes of
its turns with their depths: such names add up over ranges too, so a conversation is never gathered, however long.  Names of two
prefixes agree by chance with a probability of 2^-128.  Lexicographic order needs only the places where paths part: a node's key is the list
of those nodes on its path that have siblings (and the first), then its depth; nodes are sorted by it in ranges, which is a
preorder.  The end of a subtree is the last place among the ends of the conversations through it.  Lists hold the nodes where a path
branches, at most one for each turn.  Joins on nodes that many conversations share are broadcast if counted small; beyond, adaptive execution splits them.

Rows of null conv_id belong to no conversation.  A null role or text is empty; a null turn comes first, equal turns are ordered
by the MD5 of role and text; repeated rows are turns each.  A conversation without turns after rebuilding belongs to the root alone.  Texts are hashed whole.
Without any conversation there are no nodes; further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, ranks

NAME = ["x", "y"]  #: the two halves of a node's name; 0 for the root
PIECE = 4096  #: ids in a piece of a node's list


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), chars (code points of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def rebuilt(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with the first turns of another: base is its id, taken (up to most) how many turns are replaced.

    Returns conv_id (of each), and the rebuilt turns: conv_id, _part (a range of the conversation's turns; -1 for those of the
    base), depth (from 1), digest, chars.
    """
    dealt = ranks.dealt(turns, ["conv_id", "turn", "digest"], "turns", ("turn",))
    ranges = common.spool(ranks.ranges_of(dealt, ["conv_id"]), "ranges")
    pos = (F.col("_at") + F.col("_shift")).alias("pos")
    convs = common.spool(ranges.select("conv_id").distinct().select("conv_id", base.alias("base"), taken.alias("taken")), "conversations")
    heads = dealt.join(common.small(ranges), ["_part", "conv_id"]).select("conv_id", pos, "digest", "chars").where(F.col("pos") < most)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("heads"))
    plan = convs.join(heads, "base", "left").select("conv_id", "taken", F.coalesce(F.slice("heads", F.lit(1), F.col("taken")), F.array().cast(heads.schema["heads"].dataType)).alias("heads"))
    plan = common.spool(plan, "plan")
    shift = ranges.join(plan.select("conv_id", "taken", F.size("heads").alias("shared")), "conv_id").select("_part", "conv_id", "_shift", "taken", "shared")
    own = dealt.join(common.small(common.spool(shift, "shifts")), ["_part", "conv_id"]).withColumn("pos", F.col("_at") + F.col("_shift")).where(F.col("pos") >= F.col("taken"))
    own = own.select("conv_id", "_part", (F.col("shared") + F.col("pos") - F.col("taken") + 1).alias("depth"), "digest", "chars")
    shared = plan.select("conv_id", F.explode("heads").alias("t")).select("conv_id", F.lit(-1).cast("long").alias("_part"), (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.chars")
    return convs.select("conv_id"), own.unionByName(shared)


def named(turns: DataFrame) -> DataFrame:
    """Rebuilt turns as prefixes: conv_id, depth, x, y (the prefix), px, py (the one before), chars (of the last turn); spooled."""
    h = {"x": F.xxhash64("depth", "digest"), "y": F.xxhash64(F.lit("second"), "digest", "depth")}
    each = common.spool(turns.select("conv_id", "_part", "depth", "chars", *(v.alias(f"h{k}") for k, v in h.items())), "hashes")
    sums = each.groupBy("conv_id", "_part").agg(*(F.bit_xor(f"h{k}").alias(f"s{k}") for k in NAME))
    below = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(*ranks.BELOW)  # a row a range
    sums = common.spool(sums.select("conv_id", "_part", *(F.coalesce(F.bit_xor(f"s{k}").over(below), F.lit(0)).alias(f"b{k}") for k in NAME)), "sums")
    run = Window.partitionBy("conv_id", "_part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = each.withColumns({k: F.bit_xor(f"h{k}").over(run) for k in NAME}).join(common.small(sums), ["conv_id", "_part"])
    rows = rows.select("conv_id", "depth", "chars", *(F.col(k).bitwiseXOR(F.col(f"b{k}")).alias(k) for k in NAME), *(F.col(k).bitwiseXOR(F.col(f"b{k}")).bitwiseXOR(F.col(f"h{k}")).alias(f"p{k}") for k in NAME))
    return common.spool(rows, "prefixes")


def nodes_of(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """x, y, depth, px, py, chars, conv_id (smallest member), n_convs, n_children, head (it has siblings, or is a first turn); spooled."""
    inner = rows.groupBy(*NAME).agg(F.max("depth").alias("depth"), F.max("px").alias("px"), F.max("py").alias("py"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    inner = common.spool(inner.unionByName(root.select(zero.alias("x"), zero.alias("y"), zero.alias("depth"), none.alias("px"), none.alias("py"), zero.alias("chars"), "conv_id", "n_convs")), "nodes")
    below = inner.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"), F.min(F.struct(*NAME)).alias("child"))
    below = common.spool(below, "children")
    alone = below.where("n_children = 1 and not (x = 0 and y = 0)").select("child.x", "child.y", F.lit(False).alias("head"))
    both = inner.join(below.drop("child"), NAME, "left").join(alone, NAME, "left")
    return common.spool(both.select(*inner.columns, F.coalesce("n_children", zero).alias("n_children"), (F.coalesce("head", F.lit(True)) & (F.col("depth") > 0)).alias("head")), "trie")


def ends_of(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, x, y: the node where each conversation ends."""
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*NAME), "depth").alias("end"))
    zero = F.lit(0).cast("long")
    return common.spool(convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(f"end.{k}"), zero).alias(k) for k in NAME)), "ends")


def preorder(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes with pos (place in preorder), leaf, saved, and the prefix sums leaves and saving up to and with them; spooled.

    rows are prefixes of the conversations that come first at their end.
    """
    heads = rows.join(common.small(common.spool(nodes.where("head").select(*NAME), "heads")), NAME)
    paths = heads.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", *NAME))).alias("path"))
    way = F.transform(F.filter("path", lambda e: e["depth"] <= F.col("depth")), lambda e: F.struct(e["x"], e["y"]))
    keyed = nodes.join(paths, "conv_id", "left").withColumn("key", F.when(F.col("depth") > 0, way).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))).drop("path", "head")
    keyed = keyed.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    dealt = ranks.dealt(keyed, ["key", "depth"], "preorder", ("key",))
    sums = dealt.groupBy("_part").agg(F.min("_at").alias("first"), F.count("*").alias("n"), F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    below = Window.orderBy("_part").rowsBetween(*ranks.BELOW)  # a row a range of all nodes
    sums = sums.select("_part", "first", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"b{c}") for c in "nls"))
    run = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"leaves": F.sum("leaf").over(run), "saving": F.sum("saved").over(run)}).join(F.broadcast(sums), "_part")
    placed = placed.withColumns({"pos": F.col("_at") - F.col("first") + F.col("bn"), "leaves": F.col("leaves") + F.col("bl"), "saving": F.col("saving") + F.col("bs")})
    return common.spool(placed.drop("_part", "_at", "first", "bn", "bl", "bs"), "placed")


def member_digests(ends: DataFrame) -> DataFrame:
    """x, y, ends_sha256: SHA-256 of the ids that end at a node, ascending, comma-joined.

    Ids are joined to pieces in parallel; one task then reads a node's pieces in order, holding one batch of them.
    """
    dealt = ranks.dealt(ends, [*NAME, "conv_id"], "members")
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = dealt.groupBy(*NAME, F.floor(F.col("_at") / PIECE).alias("k")).agg(piece.alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def batch():
            x, y, digest = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(digest)], ["x", "y", "ends_sha256"])

        for b in batches:
            for x, y, text in zip(*(b.column(c).to_pylist() for c in ("x", "y", "piece")), strict=True):
                if key == (x, y):
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (x, y), sha256(text.encode())
            if done:
                yield batch()
        if key is not None:
            done.append((*key, state.hexdigest()))
            yield batch()

    return pieces.repartition(*NAME).sortWithinPartitions(*NAME, "k").select(*NAME, "piece").mapInArrow(run, "x long, y long, ends_sha256 string")


def build(conversations: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """The trie of rebuilt conversations (see rebuilt()), a row a node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and pos and last_pos, the node's interval in preorder."""
    common.ship(conversations.sparkSession)
    convs, turns = rebuilt(turns_of(conversations), base, taken, most)
    rows = named(turns)
    nodes, ends = nodes_of(convs, rows), ends_of(convs, rows)
    firsts = common.spool(ends.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id")), "firsts")
    kept = rows.join(common.small(firsts.select("conv_id")), "conv_id").select("conv_id", "depth", *NAME)
    placed = preorder(nodes, kept)
    stops = common.spool(firsts.join(placed.select(*NAME, "pos", "leaves", "saving"), NAME).select("conv_id", F.struct("pos", "leaves", "saving").alias("last")), "stops")
    last = kept.join(common.small(stops), "conv_id").groupBy(*NAME).agg(F.max("last").alias("last"))
    zero = F.lit(0).cast("long")
    last = last.unionByName(stops.agg(F.max("last").alias("last")).where("last is not null").select(zero.alias("x"), zero.alias("y"), "last"))
    parents = placed.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    inner = placed.where("depth > 1").join(parents, ["px", "py"])
    top = placed.where("depth = 0").agg(F.min("conv_id").alias("parent_conv_id"))  # one row; a first turn's parent is the root
    first = placed.where("depth = 1").crossJoin(F.broadcast(top))
    out = inner.unionByName(first.select(inner.columns)).unionByName(placed.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(inner.columns))
    full = out.join(last, NAME).join(member_digests(ends), NAME, "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("last.leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("last.saving") - F.col("saving") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"), "pos", F.col("last.pos").alias("last_pos"))


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's nodes: conversation c opens with the first turns of c - c % 100, as many as the CRC-32 of c's decimal form, modulo 6."""
    c = F.col("conv_id")
    return build(conversations, c - c % 100, (F.crc32(c.cast("string")) % 6).cast("int"), 5).drop("pos", "last_pos")
