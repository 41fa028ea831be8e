import random
import zlib
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from gleaner.llm import prefix_trie, ranks

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            t = (role or "", text or "")
            own.setdefault(c, []).append(((turn is not None, turn or 0, md5(f"{len(t[0].encode())}:{t[0]}{t[1]}".encode()).digest()), t))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    whole, members, ends = {}, {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
        ends.setdefault(whole[c], []).append(c)
    children = {p: 0 for p in members}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()]


@pytest.fixture(scope="module")
def talks():
    """Few different turns, so that paths meet and part; copies, ties, nulls, a long conversation, bases with few turns or none."""
    rng, rows = random.Random(3), []
    texts = ["a", "b", "", None, "é" * 7, "\U0001f600 x", "a\nb"]
    for c in [*range(0, 40), *range(100, 140), *range(205, 230), *range(300, 330)]:
        for t in range(rng.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None, "", "1:u"]), rng.choice(texts)))
    for c in range(400, 440):
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    rows += [(500, t, "user", "x") for t in range(2)] + [(c, t, "user", f"y{t}") for c in (501, 502, 510, 511) for t in range(3)]
    rows += [(600, t, "user" if t % 2 else "assistant", f"turn {t % 50}") for t in range(700)] + [(601, t, "user" if t % 2 else "assistant", f"turn {t % 50}") for t in range(650)]
    rows += [(600, 3, "user", "turn 3")] * 2 + [(None, 0, "user", "no id"), (None, None, None, None), (-7, 0, "user", "below"), (2**62, 0, "user", "far")]
    return rows


def test_digests(spark, talks, same):
    df, want = spark.createDataFrame(talks, SCHEMA), brute([r for r in talks if r[0] is None or r[0] >= 0])
    good = df.where("conv_id is null or conv_id >= 0")
    assert {r[1] for r in want} >= {0, 1, 700} and any(r[4] > 5 for r in want)
    same(prefix_trie.digests(good.repartition(5)), COLUMNS, want)
    extra = good.withColumns({c: F.lit(1) for c in ("x", "y", "pos", "depth", "digest", "chars", "base", "taken", "heads", "key", "path", "leaf", "_part", "_at", "_shift", "last", "head")})
    same(prefix_trie.digests(extra.coalesce(1)), COLUMNS, want)


def test_negative_ids_are_kept(spark, talks):
    out = prefix_trie.digests(spark.createDataFrame(talks, SCHEMA))
    assert out.where("depth = 0").first().conv_id == -7


def test_tables(spark, same):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    same(prefix_trie.digests(table), COLUMNS, brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))


def test_empty_and_turnless(spark, same):
    assert prefix_trie.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "gone")]
    want = brute(rows)
    assert len(want) == 1
    same(prefix_trie.digests(spark.createDataFrame(rows, SCHEMA)), COLUMNS, want)


def test_intervals_nest(spark, talks):
    c = F.col("conv_id")
    nodes = prefix_trie.build(spark.createDataFrame(talks, SCHEMA), c - c % 100, F.lit(2), 5).collect()
    assert sorted(r.pos for r in nodes) == list(range(len(nodes)))
    spans, stack = sorted((r.pos, r.last_pos, r.depth) for r in nodes), []
    for a, b, d in spans:
        while stack and stack[-1][1] < a:
            stack.pop()
        assert a <= b and len(stack) == d and all(b <= s[1] for s in stack)
        stack.append((a, b))


def test_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    ids = list(range(95, 130)) + [7, 1000]
    ends = spark.createDataFrame([(c, 1, 2) for c in ids] + [(5, 3, 4)], "conv_id long, x long, y long")
    got = {(r.x, r.y): r.ends_sha256 for r in prefix_trie.member_digests(ends).collect()}
    assert got == {(1, 2): sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (3, 4): sha256(b"5").hexdigest()}


def test_positions_over_ranges(spark):
    """A key with most of the rows, dealt over all ranges."""
    df = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 9 > 0, 1).otherwise(F.col("id")).alias("k"), (F.xxhash64("id") % 500).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ranks.dealt(df, ["k", "v"], "t")
        assert rows.select("_part").distinct().count() > 1
        got = ranks.numbered(rows, ["k"], "pos", "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.pos, r.v, r.n))
    for rows in by.values():
        assert [p for p, _, _ in sorted(rows)] == list(range(len(rows))) and {n for _, _, n in rows} == {len(rows)}
        assert [v for _, v, _ in sorted(rows)] == sorted(v for _, v, _ in rows)
