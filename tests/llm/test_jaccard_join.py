import random
import re
from itertools import combinations

import numpy as np
import pytest

from gleaner.llm import jaccard_join as J


def shingles(text, k):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([(i, s) for (i, _), s in zip(rows, sets, strict=True) if i is not None and s], 2):
        if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            x, y = top(i), top(j)
            parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else top(i)) for (i, _), s in zip(rows, sets, strict=True)]


COLUMNS = ("doc_id", "n_shingles", "component_id")


def test_contract(docs, clashing, empty, rows, same):
    want = brute(rows)
    same(J.digests(docs), COLUMNS, want)
    same(J.digests(clashing), COLUMNS, want)
    assert J.digests(empty).count() == 0


def mutated(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"z{rng.random()}"
    return words


@pytest.mark.parametrize("floor, k, percent", [(2, 2, 85), (256, 4, 85), (2, 5, 80)])
def test_groups_of_copies(spark, same, floor, k, percent):
    """Copies of a few texts with few changes: many candidates near the threshold, chains, shared passages, small sets."""
    rng, texts = random.Random(floor * 10 + k), []
    passage = [f"p{j}" for j in range(30)]
    for size in (3, 5, 12, 19, 21, 23, 25, 40, 90):
        base = [f"{size}w{j}" for j in range(size)]
        for n in range(40):
            texts.append(mutated(rng, base, rng.choice([0, 1, 1, 2, 3, max(1, size // 20)])))
            if n % 8 == 0:
                texts.append([f"u{rng.random()}" for _ in range(10)] + passage)
    rows = [(n, " ".join(w)) for n, w in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(J.join(df, k, percent, floor), COLUMNS, brute(rows, k, percent))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    job = J.Job(4, 85, 5)
    tokens = rng.integers(0, 1 << 63, 400).astype("u8")
    counts = dict(zip(tokens.tolist(), rng.integers(1, 12, 400).tolist(), strict=True))
    for _ in range(3000):
        x = rng.choice(tokens, rng.integers(1, 120), replace=False)
        y = np.union1d(x[rng.random(len(x)) < 0.93], rng.choice(tokens, rng.integers(0, 3)))
        inter = len(np.intersect1d(x, y))
        if 100 * inter >= 85 * (len(x) + len(y) - inter):
            sx, sy = (job.signatures(np.sort(s), np.array([counts[v] for v in s.tolist()])[np.argsort(s)], 5) for s in (x, y))
            assert len(np.intersect1d(sx, sy))


def test_repeated_ids_are_one_document(spark, same):
    a, b = "one two three four five", "six seven eight nine ten"
    rows = [(5, a), (5, b), (3, b), (9, a), (1, "x")]
    same(J.digests(spark.createDataFrame(rows, "doc_id long, text string")), COLUMNS, [(5, 2, 3), (5, 2, 3), (3, 2, 3), (9, 2, 3), (1, 1, 1)])


def test_many_copies_of_a_text(spark, same, monkeypatch):
    """Copies beyond MANY are looked up apart; they, near copies of them and empty texts get the same components."""
    monkeypatch.setattr(J, "MANY", 20)
    base = [f"w{j}" for j in range(40)]
    rows = [(k, " ".join(base)) for k in range(100, 160)] + [(k, " ".join(mutated(random.Random(k), base, 1))) for k in range(50, 60)]
    rows += [(k, "") for k in range(200, 240)] + [(k, "another text of its own here") for k in range(300, 330)] + [(1, "lonely words stand here today")]
    same(J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85), COLUMNS, brute(rows))


def test_other_parameters_than_the_contract(spark, same):
    """At low similarities sizes differ by more than a factor of two, and parities by more than one halving."""
    rng, rows = random.Random(8), []
    base = [f"w{j}" for j in range(1500)]
    for k, n in enumerate((300, 560, 700, 1100, 1500, 1400)):
        rows.append((k, " ".join(base[:n])))
    rows += [(10 + k, " ".join(mutated(rng, base[:900], 30 * k))) for k in range(6)]
    for percent in (40, 70):
        same(J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 2, percent), COLUMNS, brute(rows, 2, percent))


def test_long_lists_of_sets_that_do_not_link(spark, monkeypatch, same):
    """Sets that share all but their rare tokens, dealt into many parts; a few of them link."""
    monkeypatch.setattr(J, "PART", 16)
    shared = " ".join(f"c{k}" for k in range(20))
    rows = [(k, f"{shared} u{k} v{k} w{k}") for k in range(600)] + [(1000 + k, f"{shared} u{k} v{k} w{k} x{k}") for k in range(5)]
    want = brute(rows, 4, 85)
    assert len({c for _, _, c in want}) == 600
    same(J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85, floor=8), ("doc_id", "n_shingles", "component_id"), want)


@pytest.mark.parametrize("own, carried", [(32, 256), (2, 0)])
def test_a_pair_is_made_once(spark, monkeypatch, same, own, carried):
    """Texts with most of a passage each, so that pairs share many lists of different members; few link, and only what may link is made, once where all lists are known."""
    monkeypatch.setattr(J, "OWN", own)
    monkeypatch.setattr(J, "CARRIED", carried)
    made, met = [], J.Links.met

    def counted(self, alive):
        made.extend((min(r), max(r)) for r in met(self, alive).select("x", "y").collect())
        return met(self, alive)

    monkeypatch.setattr(J.Links, "met", counted)
    rng, rows = random.Random(4), []
    for size, n in ((40, 60), (360, 30)):
        passage = [f"{size}p{j}" for j in range(size)]
        for k in range(n):
            at = rng.randrange(size // 8)
            rows.append((len(rows), " ".join(passage[at : at + 7 * size // 8] + [f"u{size}x{k // 2}y{j}" for j in range(size // 20)])))
    want = brute(rows, 2, 85)
    same(J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2, 85), COLUMNS, want)
    assert len(made) < 90 * 89 / 2 * (1 if own == 32 else 5)
    assert own < 32 or len(made) == len(set(made))
