"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0).  A rule that votes has two accuracies, one on good documents and one on
bad ones (most rules are blind to most kinds of bad documents); expectation-maximisation over the counts of vote patterns
(at most 3 to the number of rules, whatever the corpus) estimates them and the share of good documents.  A document is kept
by its posterior probability of being good.  A kind of bad document is told from good ones that a noisy rule flags by several
rules that see it, so each kind has more than one.

Defined results: a null or empty text has no words, so it fails the base rule and is not kept; an empty table gives no rows;
repeated rows are judged each.  Texts are taken whole.  Columns that keep does not name are left out; it may not name one of
the output's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

#: (name, bad if, good if) over the columns of features(); a rule abstains where neither holds.
RULES = [
    ("length", "n_words < 50", "n_words >= 80"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 11 * n_words"),
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    ("duplicate_lines", "n_dup_lines > 0.5 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    ("repeats", "100 * n_repeat_words > 50 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    ("shouting", "n_marks > 0.2 * n_words or n_upper > 0.5 * word_chars", "n_marks <= 0.05 * n_words and n_upper <= 0.2 * word_chars"),
    ("sentences", "n_stops < 0.01 * n_words", "n_stops between 0.02 * n_words and 0.4 * n_words"),
    ("variety", "n_distinct < 0.15 * n_words", "n_distinct >= 0.3 * n_words"),
    ("letters", "n_letters < 0.7 * word_chars", "n_letters >= 0.85 * word_chars"),
    ("plain_words", "n_plain < 0.7 * n_words", "n_plain >= 0.95 * n_words"),
]


#: Fixed value of the contract: symbols.
SYMBOL = r"[#*$%&|<>]"
FEATURES = ("n_words", "word_chars", "n_repeat_words", "n_distinct", "n_plain", "n_lines", "n_dup_lines", "n_symbols", "n_marks", "n_upper", "n_stops", "n_letters")

#: Before the first round: a rule's vote for bad counts much, its vote for good little.  STRENGTH: documents that the prior is worth.
START, ACCURACY, STRENGTH = 0.7, (0.995, 0.1), 30


def repeat_words(w: Column) -> Column:
    """Words of array w inside three-word windows that occur twice or more; windows are sorted by hash and compared by word."""

    def marked(s):
        def same(x, y):
            return F.coalesce((x["h"] == y["h"]) & (w[x["i"]] == w[y["i"]]) & (w[x["i"] + 1] == w[y["i"] + 1]) & (w[x["i"] + 2] == w[y["i"] + 2]), F.lit(False))

        again = F.filter(F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.sequence(i, i + 2)))))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    return F.when(F.size(w) >= 3, let(F.sort_array(windows), marked)).otherwise(0).cast("long")


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and the counts that the rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    by_word = let(
        common.words_of(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.filter(w, lambda x: ~x.rlike(SYMBOL))).cast("long").alias("n_plain"),
        ),
    )
    by_line = let(
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    counts = {"n_symbols": SYMBOL, "n_marks": "!", "n_upper": r"[A-ZÀ-Þ]", "n_stops": r"[.?!]", "n_letters": r"\p{L}"}
    if clash := sorted({*keep} & {*FEATURES, "base_failed", "probability", "kept"}):
        raise ValueError(f"the input has columns {clash} already")
    counted = [F.regexp_count(t, F.lit(p)).cast("long").alias(n) for n, p in counts.items()]
    return df.select(*keep, by_word.alias("_w"), by_line.alias("_l"), *counted).select(*keep, "_w.*", "_l.*", *counts)


def votes(feats: DataFrame, rules=RULES) -> DataFrame:
    return feats.withColumns({f"vote_{n}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for n, bad, good in rules})


def fit(patterns: list[tuple[list[int], int]], m: int, rounds: int = 100) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents, and each rule's accuracy on good and on bad ones, from (votes, count).

    Rules are written so that good documents pass them: that accuracy has a prior worth
    STRENGTH documents in all, so the data set both accuracies.
    """
    prior, acc = START, [ACCURACY] * m
    before = 1 + STRENGTH
    for _ in range(rounds):
        good = total = 0.0
        cast, right = [[before, 1.0] for _ in range(m)], [[before * ACCURACY[0], ACCURACY[1]] for _ in range(m)]
        for v, n in patterns:
            p = posterior(v, prior, acc)
            good, total = good + n * p, total + n
            for j, x in enumerate(v):
                if x:
                    cast[j][0] += n * p
                    cast[j][1] += n * (1 - p)
                    right[j][x < 0] += n * (p if x > 0 else 1 - p)
        if not total:
            break
        prior = min(0.99, max(0.01, good / total))
        acc = [(min(0.999, max(0.5, r[0] / c[0])), min(0.98, max(0.02, r[1] / c[1]))) for r, c in zip(right, cast, strict=True)]
    return prior, acc


def weights(accuracy: tuple[float, float]) -> tuple[float, float]:
    """Log odds of good that a vote for good, and one for bad, add."""
    g, b = accuracy
    return math.log(g / (1 - b)), math.log((1 - g) / b)


def posterior(v: list[int], prior: float, acc: list[tuple[float, float]]) -> float:
    z = math.log(prior / (1 - prior)) + sum(weights(a)[x < 0] for x, a in zip(v, acc, strict=True) if x)
    return 1 / (1 + math.exp(-z))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules=RULES, threshold: float = 0.5) -> DataFrame:
    """keep, the features, base_failed, probability (of good) and kept."""
    voted = common.spool(votes(features(docs, text, keep), rules), "votes")
    names = [f"vote_{n}" for n, _, _ in rules]
    rows = voted.groupBy(*names).count().collect()  # at most 3 ** len(rules)
    prior, acc = fit(sorted(([r[n] for n in names], r["count"]) for r in rows), len(names))
    z = F.lit(math.log(prior / (1 - prior)))
    for n, a in zip(names, acc, strict=True):
        up, down = weights(a)
        z = z + F.when(F.col(n) > 0, up).when(F.col(n) < 0, down).otherwise(0.0)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    out = voted.withColumn("base_failed", failed).withColumn("probability", 1 / (1 + F.exp(-z)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, and probability."""
    return judge(common.spread(docs.select("doc_id", "text"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
