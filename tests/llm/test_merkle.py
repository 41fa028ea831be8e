import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    values = [None if v is None else str(v) for v in row]
    return h("-" if v is None else f"{len(v.encode())}:{v}" for v in values)


def paths(nodes, fanout):
    """Root and, of every node, its runs with its place in each, going up."""
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for path, a in zip(found, at, strict=True):
            path.append((a % fanout, runs[a // fanout]))
        nodes, at = [h(r) for r in runs], [a // fanout for a in at]
    return nodes[0], found


def brute(rows, fanout):
    """rows: doc_id, source, lang, n_chars, text."""
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for t in order:
        mine = sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf_of(r))))
        built[t] = (mine, *paths([leaf_of(r) for r in mine], fanout))
    root, above = paths([built[t][1] for t in order], fanout)
    for t, over in zip(order, above, strict=True):
        mine, subroot, own = built[t]
        for r, path in zip(mine, own, strict=True):
            whole = path + over
            proof = h(x for a, run in whole for k, x in enumerate(run) if k != a)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            digest = leaf_of((*r[:3], r[3] + 1, r[4]) if hit else r)
            for a, run in whole:
                digest = h([*run[:a], digest, *run[a + 1 :]])
            out.append((r[0], leaf_of(r), subroot, root, proof, digest, digest == root))
    return out


@pytest.fixture(scope="module")
def varied(docs):
    """Several trees, one of them null, with lengths here and there; one tree of a single leaf."""
    k = F.pmod(F.xxhash64("doc_id", "text"), F.lit(10))
    lang = F.when(F.col("doc_id") == 100_001, "zz").when(k < 6, "en").when(k < 8, "é").when(k < 9, "")
    return docs.withColumn("lang", lang).withColumn("n_chars", F.when(k != 3, F.length("text").cast("long")))


def test_digests(varied, same):
    rows = [tuple(r) for r in varied.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = brute(rows, 2)
    assert len({r[2] for r in want}) == 5 and {r[6] for r in want} == {True, False}
    same(merkle.digests(varied), COLUMNS, want)
    extra = varied.withColumns({c: F.lit(1) for c in ("tree", "pos", "total", "digest", "key", "nodes", "block", "name", "_part", "_at", "_seq", "changed")})
    same(merkle.digests(extra.repartition(7)), COLUMNS, want)


@pytest.mark.parametrize(("n", "fanout"), [(1, 2), (17, 2), (257, 2), (31, 3), (260, 5)])
def test_passes_and_fanouts(spark, same, monkeypatch, n, fanout):
    """Blocks of at most sixteen nodes, so that there are several passes."""
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, "s", f"l{i % 3}" if i > n // 2 else "a", i, f"text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaf, more = (merkle.leaf_of([F.col(c) if c != "n_chars" else F.col(c) + k for c in merkle.FIELDS]) for k in (0, 1))
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    same(merkle.manifest(df, "doc_id", "lang", leaf, F.when(hit, more), fanout), COLUMNS, brute(rows, fanout))


def test_empty_and_numbers(spark, empty):
    assert merkle.digests(empty).count() == 0
    largest = spark.createDataFrame([(k, "t", "en", "s", 2**63 - 1) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sum(not r.verified for r in merkle.digests(largest).collect()) == sum(zlib.crc32(str(k).encode()) % 7 == 0 for k in range(20))
    with pytest.raises(ValueError, match="fanout"):
        merkle.block_levels(1)
