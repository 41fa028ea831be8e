import math
import random
import re
from collections import Counter
from itertools import product

import pytest

from gleaner.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_base_columns(docs, clashing, empty, rows, same):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(Q.digests(docs), columns, [(i, *base(t)) for i, t in rows])
    same(Q.digests(clashing), columns, [(i, *base(t)) for i, t in rows])
    assert Q.digests(empty).count() == 0


def test_kept_follows_the_posterior(docs):
    """The model over single documents, without counting patterns first."""
    names = [f"vote_{n}" for n, _, _ in Q.RULES]
    out = Q.judge(docs).collect()
    prior, acc = Q.fit([([r[n] for n in names], 1) for r in out], len(names))
    for r in out:
        p = Q.posterior([r[n] for n in names], prior, acc)
        assert math.isclose(p, r.probability, rel_tol=1e-6, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    assert {r.kept for r in out} == {True, False}


def test_estimation_finds_kinds_that_one_rule_sees():
    good = [1, 1, 1, 1]
    patterns = [(good, 3000), ([1, -1, 1, 1], 270), ([1, 1, -1, 1], 60), ([1, 1, 1, 0], 200), ([-1, -1, 1, 1], 15), ([0, 0, 0, 0], 9)]
    prior, acc = Q.fit(patterns, 4)
    assert Q.posterior([1, -1, 1, 1], prior, acc) < 0.5 and Q.posterior([-1, -1, 1, 1], prior, acc) < 0.1
    assert Q.posterior(good, prior, acc) > 0.5 and Q.posterior([1, 1, 1, 0], prior, acc) > 0.5
    assert acc[1][1] > acc[3][1]  # the second rule sees more of the bad documents than the fourth
    assert Q.fit([], 2) == (Q.START, [Q.ACCURACY] * 2)


def test_a_rule_that_flags_good_documents_loses_its_weight():
    """Votes drawn from known accuracies: the last rule flags 30 % of good documents, whatever the corpus size."""
    true = [(0.99, 0.8)] * 4 + [(0.7, 0.5)]
    for size in (10_000, 1_000_000):
        patterns = []
        for v in product([1, -1], repeat=5):
            good = math.prod(g if x > 0 else 1 - g for x, (g, _) in zip(v, true, strict=True))
            bad = math.prod(b if x < 0 else 1 - b for x, (_, b) in zip(v, true, strict=True))
            patterns.append((list(v), round(size * (0.8 * good + 0.2 * bad))))
        prior, acc = Q.fit(patterns, 5)
        assert abs(prior - 0.8) < 0.02
        assert all(abs(a - b) < 0.02 for got, want in zip(acc, true, strict=True) for a, b in zip(got, want, strict=True))
        assert Q.posterior([1, 1, 1, 1, -1], prior, acc) > 0.9


def test_verdicts_agree_with_labels(spark):
    """On sf0.01: what the base rule lets through is kept as labelled, and a noisy rule's bad vote alone condemns nobody."""
    tables = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs, labels = next(tables), next(tables)
    rows = Q.judge(docs).join(labels, "doc_id", "left").collect()
    names = [f"vote_{n}" for n, _, _ in Q.RULES]
    passed = [r for r in rows if not r.base_failed and r.quality is not None]
    assert sum(r.kept == (r.quality == 1) for r in passed) >= 0.98 * len(passed) and {r.kept for r in passed} == {True, False}
    alone = [r.probability for r in rows if [r[n] for n in names].count(-1) == 1 and r.vote_length == -1]
    assert alone and min(alone) > 0.5


def test_clashing_names_are_refused(docs):
    for name in ("n_words", "kept"):
        with pytest.raises(ValueError, match=name):
            Q.judge(docs.withColumn(name, docs.doc_id), keep=("doc_id", name))


def test_a_noisy_rule_does_not_condemn_rows(spark):
    """Through judge(): a rule that flags a third of the good documents; kept agrees with the labels, dropping all with a bad vote does not."""
    rng = random.Random(11)
    words = "time people way water long little very after words called just where most know oil sound house point page letter".split()

    def prose(names):
        sentences = []
        for _ in range(40):
            s = rng.sample(words, 9)
            sentences.append(" ".join([s[0].title(), *(w.title() if names and rng.random() < 0.3 else w for w in s[1:])]) + ".")
        return " ".join(sentences)

    rows = [(k, prose(k % 3 == 0), 1) for k in range(300)]
    for k in range(300, 400):
        line = " ".join(rng.sample(words, 6)) + " ### $$$ %%% |||"
        rows.append((k, "\n".join([line + f" {rng.random()}" for _ in range(30)] + [line] * 12), 0))
    rules = [*Q.RULES, ("names", "n_upper > 60", "n_upper <= 60")]
    out = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, label long"), keep=("doc_id", "label"), rules=rules).collect()
    names = [f"vote_{n}" for n, _, _ in rules]
    assert not any(r.base_failed for r in out if r.label)
    passed = {r.doc_id: not r.base_failed and all(r[n] >= 0 for n in names) for r in out}
    kept, strict = (sum(verdict == bool(r.label) for r in out for verdict in [f(r)]) / len(out) for f in (lambda r: r.kept, lambda r: passed[r.doc_id]))
    flagged = [r for r in out if r.label and r.vote_names < 0]
    assert len(flagged) >= 90 and all(r.kept and not passed[r.doc_id] for r in flagged if [r[n] for n in names].count(-1) == 1)
    assert kept >= 0.98 and strict < 0.8
