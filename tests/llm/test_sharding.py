import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import sharding

COLUMNS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_of(key, weights):
    def draw(k):
        x = int(hashlib.md5(f"{k}:{'' if key is None else key}".encode()).hexdigest()[:13], 16)
        return -math.log((x + 0.5) / 2**52) / weights[k]

    return min(range(len(weights)), key=draw)


def brute(rows):
    each = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", shard_of(i, [1] * 8), shard_of(i, [1] * 9)) for i, t in rows]
    out, slots = [], Counter()
    for r in sorted(each, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        out.append((*r[:5], slots[r[4]], r[5]))
        slots[r[4]] += 1
    return out


def test_digests(docs, rows, empty, same):
    want = brute(rows)
    same(sharding.digests(docs), COLUMNS, want)
    extra = docs.withColumns({c: F.lit(1) for c in ("shard", "slot", "size", "_key", "_part", "_at", "_seq", "_total", "_shift", "text_crc32")})
    same(sharding.digests(extra.repartition(5)), COLUMNS, want)
    assert sharding.digests(empty).count() == 0
    moved = [r for r in want if r[4] != r[6]]
    assert moved and all(r[6] == 8 for r in moved)


def test_weights(spark):
    keys = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    weights = [1.0, 2.0, 5.0]
    found = {r.k: r.shard for r in sharding.assign(keys, "k", "t", weights).collect()}
    assert found == {k: shard_of(k, weights) for k in found}
    assert [round(Counter(found.values())[s] / 20_000, 1) for s in range(3)] == [0.1, 0.2, 0.6] or abs(Counter(found.values())[2] / 20_000 - 0.625) < 0.02
    heavier = {r.k: r.shard for r in sharding.assign(keys, "k", "t", [1.0, 2.0, 9.0]).collect()}
    assert all(found[k] == heavier[k] or heavier[k] == 2 for k in found)  # a larger weight only draws keys in
    with pytest.raises(ValueError, match="weights"):
        sharding.shard_of(F.col("k"), [1.0, 0.0])


def test_one_key_with_most_rows_and_strings(spark):
    """All in one shard, over many ranges, and without Python workers."""
    rows = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit("t").alias("t"))
    df = sharding.assign(rows, "k", "t", [1.0] * 4)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    got = df.collect()
    assert len(got) == 30_000 and len({r.shard for r in got if r.k == "hot"}) == 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
