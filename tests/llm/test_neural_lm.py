import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import neural_lm as N


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    for i, t in rows:
        w = tokens(t)
        yield i, out(i), len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w)


def test_base_columns_and_held_out_gain(docs, rows):
    got = sorted(N.digests(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = sorted(base(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9) and g.score < 0 and math.isfinite(g.score)
    held = [g for g in got if g.held_out and g.doc_id < 100_000]
    assert len(held) > 10 and sum(g.score for g in held) > sum(g.base_score for g in held)


def test_clashing_and_empty(clashing, empty, docs):
    a = sorted((r.doc_id or -1, round(r.score, 6)) for r in N.digests(clashing.where("doc_id > 99999")).collect())
    b = sorted((r.doc_id or -1, round(r.score, 6)) for r in N.digests(docs.where("doc_id > 99999")).collect())
    assert a == b
    assert N.digests(empty).count() == 0


def test_no_training_documents(spark):
    held = next(i for i in range(100) if out(i))
    row = N.digests(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_model_is_normalised_and_learns():
    """Token 0 ends texts; 2 follows 1 and 1 follows 2, unless 3 stands two places before: then 4 comes."""
    rng, o = np.random.default_rng(2), []
    for _ in range(400):
        for _ in range(8):
            o += [1, 2] if rng.random() < 0.7 else [3, 1, 4]
        o.append(0)
    o = np.array(o, "i4")
    unigram = (np.bincount(o, minlength=N.SIZE) + 0.1) / (len(o) + 0.1 * N.SIZE)
    first = N.first_model(unigram)
    learner = N.Learner(first, [np.full_like(p, 1e-8) for p in first], unigram, rng)
    one, two = N.contexts(o, N.SIZE, np.concatenate([[0], np.nonzero(o[:-1] == 0)[0] + 1]))
    learner.learn(o, one, two, (0.2, 0.01), 20)
    m = N.Model(learner.params)
    m.z = m.log_sums(m.near, *m.factors(m.far, "far"))
    a, c = np.array([1, 1, 2, N.SIZE, 4]), np.array([3, 2, 1, N.SIZE, 1])
    p = np.stack([10 ** m.log10(a, c, np.full(len(a), k)) for k in range(N.SIZE)], 1)
    assert np.allclose(p.sum(1), 1, atol=1e-3)
    assert p[0, 4] > 0.8 and p[1, 2] > 0.8  # the same word before, another two places before
    s = (m.near[a] + m.far[c]).astype("f8") @ m.q.T + m.b
    assert np.allclose(m.z[a, c], np.log(np.exp(s).sum(1)), atol=1e-3)


def test_normalisers_beyond_single_precision():
    m = N.Model(N.first_model(np.full(4, 0.25)))
    m.near, m.far, m.q, m.b = np.array([[60.0, -60.0]], "f4"), np.array([[-90.0, 90.0]], "f4"), np.array([[1.0, 0], [0, 1.0], [0, 0], [0.5, 0.5]], "f4"), np.zeros(4, "f4")
    s = (m.near[0] + m.far[0]).astype("f8") @ m.q.T
    assert m.log_sums(m.near, *m.factors(m.far, "far"))[0, 0] == pytest.approx(math.log(np.exp(s).sum()), rel=1e-5)


def test_words_share_their_class():
    """Probabilities of all words, and of one unseen word for each class, sum to one after any context."""
    words = [(N.END, 5)] + [(b"w%d" % k, 2000 - k) for k in range(1500)]
    classes = np.zeros((2, N.CLASSES))
    for w, c in words:
        classes[:, N.word_class(w) - N.OUTPUTS] += (c, 1)
    v = N.Vocabulary(words, classes[0].copy(), classes[1].copy(), 0, 0)
    at, place = v.look_up([w for w, _ in words])
    given = np.full(N.SIZE, 1 / N.SIZE)
    inside = np.where(place >= N.OUTPUTS, v.log_count[at] - v.class_log[place], 0)
    unseen = (given[N.OUTPUTS :] * 10 ** -v.class_log[N.OUTPUTS :]).sum()
    unused = N.OUTPUTS - len(set(place[place < N.OUTPUTS]))
    assert pytest.approx(1) == (given[place] * 10**inside).sum() + unseen + unused / N.SIZE


def test_vocabulary_follows_the_corpus(spark):
    """Words beyond the first OUTPUTS have an output and a context of their own, and what follows them is learnt."""
    rng = np.random.default_rng(1)
    pairs = 3000  # words a<k>, each followed by its own b<k>
    texts = [" ".join(f"a{k} b{k}" for k in rng.integers(0, pairs, 200)) for _ in range(1500)]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "doc_id long, text binary").repartition(4)
    N.common.ship(spark)
    counts = N.count_words(rows).cache()
    vocab = N.vocabulary(counts)
    assert vocab.outputs == int(N.GROWTH * (1500 * 401) ** 0.5) > N.OUTPUTS
    model = N.train(N.numbered(rows, vocab), vocab)
    own = N.first_model(vocab.unigram)
    assert [x.shape for x in (model.q, model.b, model.near)] == [x.shape for x in (own[1], own[2], own[0])]
    given = np.exp((model.near[:50] + model.far[50:100]).astype("f8") @ model.q.T + model.b - model.z[np.arange(50), np.arange(50, 100)][:, None])
    assert np.allclose(given.sum(1), 1, atol=1e-3)
    follows = [vocab.output[[vocab.index[b"%s%d" % (x, k)] for x in (b"a", b"b")]] for k in range(200)]
    gains = [(model.log10(np.array([c]), np.array([follows[(k + 1) % 200][1]]), np.array([o]))[0] - np.log10(vocab.unigram[o])) for k, (c, o) in enumerate(follows)]
    assert np.median(gains) > np.log10(5)


@pytest.mark.parametrize("ended", [True, False])
def test_look_up_by_single_words(ended):
    """Index and output of words in the head, of others and of the end token, looked up word by word."""
    head = [(b"the", 9), (b"of", 5), (b"rare", 1)] + [(N.END, 7)] * ended
    vocab = N.Vocabulary(head, np.full(N.CLASSES, 99.0), np.full(N.CLASSES, 99.0), 200, 90, 3)
    words, starts = N.flat([b"The of xy", None, b" \n", b"rare q the \xff"])
    assert words == [b"the", b"of", b"xy", N.END, N.END, N.END, b"rare", b"q", b"the", b"\xff", N.END] and starts.tolist() == [0, 4, 5, 6]
    at, out = vocab.look_up(words)
    places = [w for w, _ in head]
    assert at.tolist() == [places.index(w) if w in places else -1 for w in words]
    own = [N.END, b"the", b"of"]
    assert out.tolist() == [own.index(w) if w in own and w in places else N.word_class(w, 3) for w in words]


def test_texts_are_read_twice(spark, rows):
    """Once for the counts of words, and once for numbers that training and scores share."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    few = spark.createDataFrame([r for r in rows if r[0] is not None][-40:], "doc_id long, text string").repartition(spark.sparkContext.defaultParallelism)
    assert len(N.digests(few.mapInArrow(counted, few.schema)).collect()) == 40
    assert read.value == 2 * 40


def test_step_against_plain_form():
    """A step of training in double precision, token by token."""
    rng, size, n = np.random.default_rng(4), 90, 200
    unigram = rng.dirichlet(np.ones(size))
    start = [rng.normal(0, 0.5, x.shape).astype("f4") for x in N.first_model(unigram)]
    o, one, two = rng.integers(0, 40, n), rng.integers(0, size + 1, n), rng.integers(0, size + 1, n)
    learner = N.Learner(start, [np.full_like(x, 1e-8) for x in start], unigram, np.random.default_rng(9))
    learner.learn(o, one, two, (0.2, 0.1))
    same = np.random.default_rng(9)
    same.permutation(n)
    drawn = np.searchsorted(np.cumsum(unigram), same.random(N.DRAWN) * unigram.sum())
    words, q, b, near, far = before = [x.astype("f8") for x in start]
    grads, level = [np.zeros_like(x) for x in before], np.log(N.NOISE * unigram)
    for out, a, c in zip(o, one, two, strict=True):
        context, g = words[a] @ near + words[c] @ far, np.zeros(N.DIM)
        for w, weight, true in [(out, 1, 1), *((w, N.NOISE / N.DRAWN, 0) for w in drawn)]:
            e = weight * (1 / (1 + np.exp(level[w] - b[w] - context @ q[w])) - true)
            g += e * q[w]
            grads[1][w] += e * context
            grads[2][w] += e
        grads[0][a] += near @ g
        grads[0][c] += far @ g
        grads[3] += np.outer(words[a], g)
        grads[4] += np.outer(words[c], g)
    for x, y, g in zip(learner.params, before, grads, strict=True):
        assert np.allclose(x, y - 0.2 * g / np.sqrt(1e-8 + g * g), atol=2e-3)


def test_words_of_the_tail_by_text():
    """Distinct words without an index, and how often each text has them; the classes of words."""
    rng = np.random.default_rng(6)
    texts = [b" ".join(bytes(rng.integers(97, 103, rng.integers(1, 4)).tolist()) for _ in range(k)) for k in (0, 1, 300, 40, 0, 500)]
    words, starts = N.flat(texts)
    vocab = N.Vocabulary([(w, 2) for w in sorted(set(words))[::3]], np.full(N.CLASSES, 9.0), np.full(N.CLASSES, 9.0), 9, 9, 20)
    at, _ = vocab.look_up(words)
    rest, times = N.listed(N.pa.array(words, N.pa.binary()), at < 0, starts)
    want = [Counter(w for w in N.tokens(t) if w not in vocab.index) for t in texts]
    assert [dict(zip(*x, strict=True)) for x in zip(rest.to_pylist(), times.to_pylist(), strict=True)] == want
    some = N.pa.array(words, N.pa.binary())[5:]
    assert N.word_classes(some).tolist() == [N.word_class(w) - N.OUTPUTS for w in words[5:]]
