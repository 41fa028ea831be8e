"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every shard draws a number for every key: minus the logarithm of a uniform hash of shard and key, divided by the shard's
weight; the least draw takes the key.  A key's shard depends on the key and the shards' weights alone.  A shard that is added
takes keys to itself and moves no other; one that is removed gives up its own keys; a larger weight only draws keys in.

Slots number the rows of a shard from 0 without gaps, ascending by key (null first), size and CRC-32 of the text; rows that are
equal in these may change places.  No shard is gathered in one task: rows are dealt into ranges of the order, and each range is
shifted by the counts of those below.

The key may be of any type that can be written as a string; a null key is drawn for as an empty string, so its rows are together.  A null text has
no bytes: size 1 and CRC-32 0.  Equal keys are in one shard, whatever their texts; repeated rows have a slot each.  An empty
table gives no rows; further columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ranks

SHARDS = 8
DIGITS = 13  #: of the hash, in base 16: 52 bits, exact as doubles


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's draw for a key: exponential with the weight as its rate."""
    if weight <= 0:
        raise ValueError("weights are above 0")
    digest = F.md5(F.concat(F.lit(f"{shard}:"), key))
    uniform = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(uniform) / weight


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard with the least draw; among equal ones the first."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    draws = F.array(*(F.struct(draw(text, k, w).alias("draw"), F.lit(k).alias("shard")) for k, w in enumerate(weights)))
    return F.array_min(draws)["shard"]


def assign(docs: DataFrame, key: str, text: str, weights: list[float], grown: float | None = None) -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard (with one more shard, of the weight grown; else null)."""
    common.ship(docs.sparkSession)
    n, crc = F.coalesce(F.octet_length(text), F.lit(0)), F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0))
    more = F.lit(None).cast("int") if grown is None else shard_of(F.col(key), [*weights, grown])
    rows = docs.select(F.col(key).alias("_key"), (n.cast("long") + 1).alias("size"), crc.cast("long").alias("text_crc32"), shard_of(F.col(key), weights).alias("shard"), more.alias("grown_shard"))
    placed = ranks.numbered(ranks.dealt(rows, ["shard", "_key", "size", "text_crc32"], "sharded"), ["shard"], "slot")
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, over SHARDS equal shards and one more."""
    placed = assign(common.spread(docs.select("doc_id", "text")), "doc_id", "text", [1.0] * SHARDS, 1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
