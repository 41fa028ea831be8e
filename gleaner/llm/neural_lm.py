"""Language-model scoring with a log-bilinear model in numpy, trained by noise-contrastive estimation.

Outputs are the most frequent words (the end token among them) and CLASSES classes of all other words, by their last two
bytes; inside a class a word has its smoothed relative frequency.  The number of words with an output, and a context, of
their own is GROWTH times the square root of the training tokens (OUTPUTS at least, MOST at most: the vectors and the
normalisers are broadcast, and exact normalisation is quadratic in it).

The context vector of a token is the sum of the vectors of the two words before it, each transformed by the matrix of its position;
s = context . q[output] + b[output].  A normaliser sums exp(s) over all outputs.  As the exponential of a sum is a product,
the normalisers of all pairs of context words are one matrix product over the outputs, made in blocks by tasks: a table of at most
(MOST + CLASSES + 1) squared numbers.

Documents are turned to numbers once, which training and scores read.  In each of ROUNDS rounds every task takes noise-contrastive steps over a part of its tokens, each token
against NOISE draws from the unigram distribution, for which DRAWN words stand in a step.  Vectors, weighted by the tokens a task saw
of them, are added up block by block in tasks; the driver reads one model a round.  Small corpora have fewer tasks and more
passes in a round.

Word counts are taken over all training documents.  Documents look up the HEAD most frequent words (or those with an output, if more) in a table;
other words meet their counts in a join.  A null text is an empty one (the end token alone); a null doc_id counts as
training; repeated rows are counted and scored each; without training documents all scores are uniform.  An empty table gives no
rows; columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OUTPUTS, CLASSES, HEAD = 1023, 65, 32_768
SIZE = OUTPUTS + CLASSES  #: outputs; as a context, SIZE is the start of a text
GROWTH, MOST = 4, 4096  #: words with an output of their own: per square root of a training token, and at most
DIM, NOISE, DRAWN, ROUNDS, RATE, LAST = 32, 10, 256, 4, 0.2, 0.005
BATCH, STEPS = 4096, 400  #: tokens of a step at most; steps that a task takes in a round at least
SLICE, HELD, SHARE = 1 << 14, 1 << 20, 500_000  #: tokens of one turn in a row; in a task's memory; of a corpus for each of its tasks at least
ENOUGH = 1_000_000  #: tokens below which a round goes over its part several times
ROWS = 512  #: vectors in a block
CACHED = 64  #: tokens whose noise scores are worked on at a time
END = b""  #: no word is empty
FLUSH = 600_000  #: counts of batches' words that a task holds before it adds them up and hands them on


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words, then the end token; bytes.split() splits at ASCII white space alone."""
    return [*(text or b"").lower().split(), END]


def word_class(word: bytes, outputs: int = OUTPUTS) -> int:
    return outputs if word == END else outputs + (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % CLASSES


def word_classes(words: pa.Array) -> np.ndarray:
    """word_class of every word, less the outputs."""
    ends, data = (np.frombuffer(x or b"", t) for x, t in zip(words.buffers()[1:], ("i4", "u1"), strict=True))
    ends = ends[words.offset : words.offset + len(words) + 1]
    data, size, ends = np.concatenate([np.zeros(2, "u1"), data]), np.diff(ends), ends[1:]
    return np.where(size > 0, (data[ends + 1].astype("i4") * 31 + np.where(size > 1, data[ends], 0)) % CLASSES, 0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(training: DataFrame) -> DataFrame:
    """word, c over the texts (binary) of all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            yield from sums.select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches()

        common.worker_table("neural_lm")
        held, size = [], 0
        for b in common.sliced(batches):
            found = pa.array(flat(b.column("text").to_pylist())[0], pa.binary()).value_counts()
            held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
            size += len(found)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    parts = training.select("text").mapInArrow(run, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The end token and the most frequent words (HEAD in all, or outputs if more): index, output and log10(count + 1) of each; classes' counts of tokens and words."""

    def __init__(self, head: list[tuple[bytes, int]], class_tokens: np.ndarray, class_words: np.ndarray, total: int, distinct: int, outputs: int = OUTPUTS):
        own = [END, *[w for w, _ in head if w != END][: outputs - 1]]
        self.outputs, self.size = outputs, outputs + CLASSES
        place = {w: k for k, w in enumerate(own)}
        self.index, self.head = {w: k for k, (w, _) in enumerate(head)}, pa.array([w for w, _ in head], pa.binary())
        self.output = np.array([place[w] if w in place else word_class(w, outputs) for w, _ in head], "i4")
        self.log_count = np.log10(np.array([c for _, c in head], "f8") + 1)
        tokens = np.zeros(outputs)
        for w, c in head:  # what has an output of its own is in no class
            if w in place:
                tokens[place[w]] = c
                class_tokens[word_class(w) - OUTPUTS] -= c
                class_words[word_class(w) - OUTPUTS] -= 1
        self.class_log = np.concatenate([np.zeros(outputs), np.log10(class_tokens + class_words + 1.0)])
        self.unigram = np.concatenate([tokens, class_tokens]) + 0.1
        self.unigram /= self.unigram.sum()
        self.total, self.distinct = total, distinct

    def look_up(self, words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index in the head (-1: none) and output of every word."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        at = pc.index_in(words, value_set=self.head).fill_null(-1).to_numpy(zero_copy_only=False)
        out = self.output[at] if len(self.output) else np.zeros(len(at), "i4")
        tail = at < 0
        out[tail] = self.outputs + word_classes(words.filter(pa.array(tail)))
        return at, out


def vocabulary(counts: DataFrame) -> Vocabulary:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, CLASSES), "i8")
        for b in common.sliced(batches, 1 << 20):
            classes = word_classes(b.column("word"))
            found[0] += np.bincount(classes, b.column("c").to_numpy(), CLASSES).astype("i8")
            found[1] += np.bincount(classes, minlength=CLASSES)
        yield pa.RecordBatch.from_pydict({"class": range(CLASSES), "tokens": found[0], "words": found[1]})

    sums = {r["class"]: r for r in counts.mapInArrow(run, "class long, tokens long, words long").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()}
    by_class = np.array([[sums[k]["tokens"], sums[k]["words"]] if k in sums else [0, 0] for k in range(CLASSES)], "f8").T
    total, distinct = int(by_class[0].sum()), int(by_class[1].sum())
    outputs = min(MOST, max(OUTPUTS, int(GROWTH * total**0.5)))
    head = [(bytes(r.word), r.c) for r in counts.orderBy(F.octet_length("word") > 0, F.desc("c"), "word").limit(max(HEAD, outputs)).collect()]
    return Vocabulary(head, by_class[0].copy(), by_class[1].copy(), total, distinct, outputs)


def flat(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of all texts, and where each text's begin (every text has its end token)."""
    words, sizes = [], []
    for t in texts:
        w = (t or b"").lower().split()
        words += w
        words.append(END)
        sizes.append(len(w) + 1)
    return words, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("i8")


def contexts(out: np.ndarray, size: int = SIZE, starts=(0,)) -> tuple[np.ndarray, np.ndarray]:
    """Outputs one and two places before each, size before a text's start; starts: where texts begin."""
    starts = np.asarray(starts)
    one, two = np.full(len(out), size, out.dtype), np.full(len(out), size, out.dtype)
    one[1:], two[2:] = out[:-1], out[:-2]
    one[starts] = two[starts] = size
    second = starts + 1
    ends = np.append(starts[1:], len(out))
    two[second[second < ends]] = size
    return one, two


def listed(words: pa.Array, tail: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Of each text's words in the tail: the distinct ones, and how often they stand in it."""
    rest = words.filter(pa.array(tail)).dictionary_encode()
    text, wide = np.searchsorted(starts, np.flatnonzero(tail), "right") - 1, max(1, len(rest.dictionary))
    pairs, times = np.unique(text * wide + rest.indices.to_numpy(), return_counts=True)
    begin = pa.array(np.searchsorted(pairs, np.arange(len(starts) + 1) * wide), pa.int32())
    return [pa.ListArray.from_arrays(begin, x) for x in (rest.dictionary.take(pa.array(pairs % wide)), pa.array(times, pa.int64()))]


NUMBERS = "row long, doc_id long, held_out boolean, turn int, ids binary, n_tokens long, known long, base double, own double, rest array<binary>, times array<long>"


def numbered(docs: DataFrame, vocab: Vocabulary, held_out=None) -> DataFrame:
    """All documents, split and looked up once; spooled.  held_out: a column; without it all are for training.

    turn: the round that learns from a training document, about SLICE tokens in a row; ids: outputs of its tokens; known, base: number of its tokens in the head and
    the sum of their log10(count + 1); own: log10 of its tokens' shares in their classes, but for the counts of words that are not in the head;
    rest, times: these words and how often they stand in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_table("neural_lm")
        vocab, before = shared.value, 0
        first = TaskContext.get().partitionId()  # few documents a task are spread over the rounds
        for b in common.sliced(batches):
            words, starts = flat(b.column("text").to_pylist())
            words = pa.array(words, pa.binary())
            at, out = vocab.look_up(words)
            tail, ends = at < 0, np.append(starts[1:], len(words))
            by_count = np.where(tail, 0.0, vocab.log_count[at] if len(vocab.log_count) else 0.0)
            own = np.where(out >= vocab.outputs, by_count, 0.0) - vocab.class_log[out]
            known, base, own = (np.add.reduceat(x, starts) for x in ((~tail).astype("i8"), by_count, own))
            n, held = ends - starts, b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            seen = before + np.cumsum(np.where(held, 0, n))
            turn = (first + np.append(before, seen[:-1]) // SLICE) % ROUNDS
            before, ids = int(seen[-1]), out.astype("u2").tobytes()
            columns = [pa.array(turn, pa.int32(), mask=held), pa.array([ids[2 * i : 2 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()), *listed(words, tail, starts)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("held_out"), *columns], ["row", "doc_id", "held_out", "turn", "ids", "n_tokens", "known", "base", "own", "rest", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"), "text")
    return common.spool(rows.mapInArrow(run, NUMBERS), "numbers")


def joined(ids: pa.Array) -> np.ndarray:
    """The outputs of all documents of a batch."""
    return np.frombuffer(b"".join(ids.to_pylist()), "u2")


def right(s: np.ndarray) -> np.ndarray:
    """Probability that a token came from the data, in place of its score with the sign turned."""
    with np.errstate(over="ignore"):  # the exponential of a large number is infinite, and the probability 0
        np.exp(s, out=s)
    s += 1
    return np.divide(np.float32(1), s, out=s)


def noise_sums(context: np.ndarray, q: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the probabilities right(level - context . q): their sums over the outputs q by each context, and over the contexts by each output.

    Outputs are weighted by their vectors, contexts by theirs and the 1 in their last column.  As right(s) = (1 - tanh(s / 2)) / 2, the tables hold
    the hyperbolic tangent alone, and both sums follow from its.
    """
    turned = np.empty((context.shape[1], len(q)), "f4")
    turned[:-1], turned[-1] = q.T * np.float32(-0.5), level / 2
    each, drawn = np.empty((len(context), q.shape[1]), "f4"), np.zeros((len(q), context.shape[1]), "f4")
    table, part = np.empty((CACHED, len(q)), "f4"), np.empty_like(drawn)
    for j in range(0, len(context), CACHED):  # scores that stay in the processor's cache
        some = context[j : j + CACHED]
        t = np.matmul(some, turned, out=table[: len(some)])
        np.tanh(t, out=t)
        np.matmul(t, q, out=each[j : j + CACHED])
        drawn += np.matmul(t.T, some, out=part)
    return (q.sum(0) - each) / 2, (context.sum(0) - drawn) / 2


class Groups:
    """Equal numbers (16 bits) of a list: rows are the distinct ones."""

    def __init__(self, at: np.ndarray):
        self.by = np.argsort(at, kind="stable")  # of 16-bit numbers: by radix
        found = at.take(self.by)
        new = np.concatenate([[True], found[1:] != found[:-1]])
        self.begin = np.flatnonzero(new)
        self.rows, self.place = found[self.begin].astype("i8"), np.empty(len(at), "i8")
        self.place[self.by] = np.cumsum(new) - 1  # of each number in rows

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (single precision) by row; vectors are added two numbers at a time, as complex ones."""
        values = values.take(self.by, 0)
        if values.ndim == 1:
            return np.add.reduceat(values, self.begin)
        return np.add.reduceat(values.view("c8"), self.begin).view("f4")


class Learner:
    """A model and the sums of its squared gradients: words' vectors, outputs' vectors and biases, the matrices of both positions."""

    def __init__(self, params: list[np.ndarray], squares: list[np.ndarray], unigram: np.ndarray, rng):
        self.params, self.squares, self.rng = [p.copy() for p in params], [s.copy() for s in squares], rng
        self.shift, self.cdf = np.log(NOISE * unigram).astype("f4"), np.cumsum(unigram)
        self.mass = [np.zeros(len(p)) for p in params]

    def move(self, k: int, rows, g: np.ndarray, rate: float) -> None:
        """A step of rows of parameter k, each named once."""
        square = self.squares[k][rows] + g * g
        self.squares[k][rows] = square
        np.divide(g, np.sqrt(square, out=square), out=square)
        square *= rate
        self.params[k][rows] -= square

    def learn(self, o: np.ndarray, one: np.ndarray, two: np.ndarray, rates: tuple[float, float], passes: int = 1) -> None:
        """Steps over tokens o after the words one and two places before, in random order, the rate going down."""
        words, q, b, near, far = self.params
        n, top = len(o), len(self.cdf) - 1
        o, one, two = (x.astype("u2") for x in (o, one, two))
        batch, share = min(BATCH, max(256, n * passes // STEPS)), np.float32(NOISE / DRAWN)
        moved, seen = np.zeros_like(words), np.zeros(len(words), bool)
        for turn in range(passes):
            order = self.rng.permutation(n)
            for k in range(0, n, batch):
                i = order[k : k + batch]
                rate = np.float32(rates[0] + (rates[1] - rates[0]) * (turn + k / n) / passes)
                out, a, c = o[i], Groups(one[i]), Groups(two[i])
                w = np.minimum(np.searchsorted(self.cdf, self.rng.random(DRAWN) * self.cdf[-1]), top).astype("u2")
                va, vc, qo, qw = words[a.rows], words[c.rows], q.take(out, 0), q.take(w, 0)
                context = np.ones((len(i), DIM + 1), "f4")
                np.add((va @ near).take(a.place, 0), (vc @ far).take(c.place, 0), out=context[:, :DIM])
                e = right(self.shift[out] - b[out] - np.einsum("ij,ij->i", context[:, :DIM], qo)) - 1
                g, drawn = noise_sums(context, qw, self.shift[w] - b[w])
                g *= share
                g += e[:, None] * qo
                ga, gc = a.sums(g), c.sums(g)  # what a word moves by in all its places is transformed once
                moved[a.rows] = ga @ near.T
                moved[c.rows] += gc @ far.T
                seen[a.rows] = seen[c.rows] = True
                own = np.flatnonzero(seen)
                drawn *= share
                outputs = Groups(np.concatenate([out, w]))
                gq, gb = outputs.sums(np.concatenate([e[:, None] * context[:, :DIM], drawn[:, :DIM]])), outputs.sums(np.concatenate([e, drawn[:, DIM]]))
                for j, at, grad in ((1, outputs.rows, gq), (2, outputs.rows, gb), (0, own, moved.take(own, 0)), (3, slice(None), va.T @ ga), (4, slice(None), vc.T @ gc)):
                    self.move(j, at, grad, rate)
                moved[own], seen[own] = 0, False
        self.mass[0] += np.bincount(one, minlength=len(words)) + np.bincount(two, minlength=len(words))
        for k in (1, 2):
            self.mass[k] += np.bincount(o, minlength=len(q))
        for k in (3, 4):
            self.mass[k] += n

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """k, block, mass, value, square: weighted rows that were seen, in blocks of ROWS."""
        for k, (p, s, m) in enumerate(zip(self.params, self.squares, self.mass, strict=True)):
            for j in range(0, len(p), ROWS):
                w = m[j : j + ROWS]
                if w.any():
                    wide = w.reshape(-1, *[1] * (p.ndim - 1))
                    parts = [w, wide * p[j : j + ROWS], wide * s[j : j + ROWS]]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([j // ROWS], pa.int32()), *(pa.array([x.astype("f8").tobytes()], pa.binary()) for x in parts)], ["k", "block", "mass", "value", "square"])


BLOCKS = "k int, block int, mass binary, value binary, square binary"


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the same place added up, element by element."""
    sums: dict = {}
    for b in batches:
        for k, j, *parts in zip(*(b.column(c).to_pylist() for c in ("k", "block", "mass", "value", "square")), strict=True):
            arrays = [np.frombuffer(x) for x in parts]
            sums[k, j] = [a + x for a, x in zip(sums[k, j], arrays, strict=True)] if (k, j) in sums else arrays
    for (k, j), arrays in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([j], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], ["k", "block", "mass", "value", "square"])


def first_model(unigram: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Unigram probabilities after every context; the last word is the start of a text."""
    words = np.random.default_rng(seed).normal(0, 0.1, (len(unigram) + 1, DIM)).astype("f4")
    return [words, np.zeros((len(unigram), DIM), "f4"), np.log(unigram).astype("f4"), np.eye(DIM, dtype="f4"), np.eye(DIM, dtype="f4") / 2]


class Model:
    """near, far: the words' vectors transformed for both positions; q, b; z: logarithms of the normalisers by both context words."""

    def __init__(self, params: list[np.ndarray]):
        words, self.q, self.b, near, far = params
        self.near, self.far, self.z = words @ near, words @ far, None

    def factors(self, rows: np.ndarray, which: str) -> tuple[np.ndarray, np.ndarray]:
        """exp of the scores' parts of context words, less their largest, and the largest; the bias goes with the nearer word."""
        s = rows @ self.q.T
        if which == "near":
            s += self.b
        top = s.max(1)
        return np.exp(np.subtract(s, top[:, None], out=s), out=s), top

    def log_sums(self, near: np.ndarray, far: np.ndarray, far_top: np.ndarray) -> np.ndarray:
        """Logarithms of the normalisers of some nearer words (rows of self.near) and all farther ones."""
        a, top = self.factors(near, "near")
        z = a @ far.T
        with np.errstate(divide="ignore"):
            out = np.log(z) + top[:, None] + far_top
        for i, j in zip(*np.nonzero(z < 1e-30), strict=True):  # their largest parts lie too far apart for single precision
            s = (near[i] + self.far[j]).astype("f8") @ self.q.T + self.b
            out[i, j] = s.max() + np.log(np.exp(s - s.max()).sum())
        return out.astype("f4")

    def log10(self, one: np.ndarray, two: np.ndarray, out: np.ndarray, step: int = 8192) -> np.ndarray:
        """log10 probabilities of outputs after the words one and two places before, some at a time so that what is gathered stays in the processor's cache."""
        p = np.empty(len(out))
        for k in range(0, len(out), step):
            i, j, o = one[k : k + step], two[k : k + step], out[k : k + step]
            p[k : k + step] = np.einsum("ij,ij->i", self.near.take(i, 0) + self.far.take(j, 0), self.q.take(o, 0)) + self.b.take(o) - self.z[i, j]
        return p / np.log(10)


def normalise(spark, model: Model) -> Model:
    """The model with its table of normalisers: blocks of rows are made by tasks, each with all farther words' factors."""
    sc, n = spark.sparkContext, len(model.near)
    shared, parts = sc.broadcast(model), max(1, min(sc.defaultParallelism, n // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, far = shared.value, None
        for b in batches:
            for i in b.column("id").to_pylist():
                far = far or model.factors(model.far, "far")
                yield pa.RecordBatch.from_pydict({"id": [i], "z": [model.log_sums(model.near[64 * i : 64 * i + 64], *far).tobytes()]})

    model.z = np.empty((n, n), "f4")
    table = common.spool(spark.range(0, -(-n // 64), 1, parts).mapInArrow(run, "id long, z binary"), "normalisers")
    for r in table.toLocalIterator():
        rows = np.frombuffer(bytes(r.z), "f4").reshape(-1, n)
        model.z[64 * r.id : 64 * r.id + len(rows)] = rows
    common.drop(table)
    shared.unpersist()
    return model


def train(numbers: DataFrame, vocab: Vocabulary) -> Model:
    """The model fitted to those of the numbered documents that have a turn, with its normalisers."""
    spark, sc = numbers.sparkSession, numbers.sparkSession.sparkContext
    unigram, size, total = vocab.unigram, vocab.size, max(1, vocab.total)
    tasks = max(1, min(sc.defaultParallelism, total // SHARE))
    passes, expected = -(-ENOUGH // total) if total < ENOUGH else 1, max(1, total / tasks / ROUNDS)
    passes = min(passes, 8)
    params = first_model(unigram)
    squares = [np.full_like(p, 1e-8) for p in params]
    for turn in range(ROUNDS):
        shared = sc.broadcast((params, squares))

        def local(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            common.worker_table("neural_lm")
            learner, held, seen = Learner(*shared.value, unigram, np.random.default_rng([7, turn])), [], 0

            def rate(done: float) -> float:
                return LAST + RATE * (1 - (turn + min(1.0, done / expected)) / ROUNDS)

            def learn(seen: int) -> None:
                o = np.concatenate(held).astype("i4")
                one, two = contexts(o, size, np.concatenate([[0], np.nonzero(o[:-1] == 0)[0] + 1]))
                learner.learn(o, one, two, (rate(seen), rate(seen + len(o))), passes)
                held.clear()

            for b in common.sliced(batches, HELD):
                held.append(joined(b.column("ids")))
                if (n := sum(map(len, held))) >= HELD:
                    learn(seen)
                    seen += n
            if held:
                learn(seen)
            yield from learner.blocks()

        found = numbers.where(F.col("turn") == turn).select("ids").coalesce(tasks).mapInArrow(local, BLOCKS)
        sums = common.spool(found.repartition(4, "k", "block").mapInArrow(added, BLOCKS), "vectors")
        params, squares = [p.copy() for p in params], [s.copy() for s in squares]
        for r in sums.toLocalIterator():  # one model
            at = slice(ROWS * r.block, ROWS * (r.block + 1))
            w = np.frombuffer(bytes(r.mass))
            own = w > 0
            for arrays, data in ((params, r.value), (squares, r.square)):
                rows = np.frombuffer(bytes(data)).reshape(len(w), -1)[own] / w[own, None]
                arrays[r.k][at][own] = rows.reshape(-1, *arrays[r.k].shape[1:])
        common.drop(sums)
        shared.unpersist()
    return normalise(spark, Model(params))


def score(numbers: DataFrame, vocab: Vocabulary, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every numbered document."""
    shared = numbers.sparkSession.sparkContext.broadcast(model)
    base_log, size = float(np.log10(vocab.total + vocab.distinct + 1.0)), vocab.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_table("neural_lm")
        model = shared.value
        for b in common.sliced(batches, HELD):
            out, n = joined(b.column("ids")), b.column("n_tokens").to_numpy()
            starts = np.cumsum(n) - n
            p = np.add.reduceat(model.log10(*contexts(out, size, starts), out), starts) + b.column("own").to_numpy()
            kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p, pa.float64())], [*kept, "model"])

    rows = numbers.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "own", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double")
    rare = numbers.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word")
    sums = met.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    logs = F.coalesce(F.col("logs"), F.lit(0.0))
    return rows.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("more"), F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * base_log).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    common.ship(docs.sparkSession)
    rows = common.spread(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")))
    counts = common.spool(count_words(rows.where(~F.col("held_out"))), "counts")
    vocab = vocabulary(counts)
    numbers = numbered(rows, vocab, F.col("held_out"))
    return score(numbers, vocab, train(numbers, vocab), counts)
