from gleaner.functions.kernels import negated


def test_negators_far_before_a_match():
    for gap in ("| " * 300, "x" * 500 + " "):
        text = f"there is no {gap}crime"
        assert negated(text, text.index("crime"), {"no"})
    text = "un" + "not" + " " * 393 + "a b c crime"  # a token is cut at 400 characters
    start = text.index("crime")
    assert not any(negated("z" * k + text, start + k, {"not", "ot", "t"}) for k in range(10))
    assert not negated("no one two three four crime", 22, {"no"})


def test_native_forms_equal_the_kernels(spark):
    """Column forms against the functions on single texts, over texts made of what matters to them."""
    import random

    from pyspark.sql import functions as F

    from gleaner.functions import kernels, text

    rng = random.Random(9)
    bits = ["price", "Price", "ann price", "court", "not", "never", "said", "according to", ". ", "! ", "\n", '"', "“", "”", " ", " ", " ", "'s", "é", "zz", "1", ",", "far from", "x" * 45, "😀"]
    texts = [None, "", *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(400))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    patterns, negators, phrases = (r"price", r"court"), ("not", "never"), ("far from",)
    found, outside = text.pattern_hit(F.col("t"), patterns, negators, phrases)
    gated = text.gated_mentions(F.col("t"), "price", r"\bcourt", "ann", 30)
    central = text.centrality(F.lit("no"), F.col("t"), r"(?:price|court)")
    for r in df.select("k", found.alias("f"), outside.alias("o"), gated.alias("g"), *(c.alias(n) for n, c in central.items())).collect():
        t = texts[r.k] or ""
        assert (r.f, r.o) == kernels.pattern_hit(t, patterns, frozenset(negators), phrases), t
        assert r.g == kernels.gated_mentions(t, "price", r"\bcourt", 30, "ann"), t
        want = kernels.centrality("no", t, r"(?:price|court)")
        assert all(abs(a - b) < 1e-9 for a, b in zip((r.head, r.lede, r.density, r.plain, r.subject, r.total), want, strict=True)), t


def test_centrality_by_hand():
    from gleaner.functions import kernels

    head, lede, density, plain, subject, total = kernels.centrality("Target wins", "The target said no. " + "x " * 30 + "target left. According to target, all is well.", r"\btarget\b")
    assert (head, lede) == (1, 1)
    n, words = 3, 4 + 30 + 2 + 6
    assert density == (100 * n / words) / (100 * n / words + 1)
    assert plain == 1 - 2 / 3  # "said" behind the first, "According to" before the third
    assert subject == 2 / 3  # the second stands 60 characters behind the full stop
    assert total == round(0.25 + 0.15 + 0.2 * density + 0.25 * plain + 0.15 * subject, 4)


def test_curly_quotes_do_not_swallow_the_next_one():
    from gleaner.functions import kernels

    assert kernels.quote_spans("“unclosed and “closed one” end") == [(14, 26)]


def test_matches_do_not_read_the_text_before_them_again(spark):
    """No part of the text from its start is taken for a match, and long texts of negated and quoted matches equal the kernels."""
    from pyspark.sql import functions as F

    from gleaner.functions import kernels, text

    texts = ["not one price, " * 700, "not a b c " + '"price\'s", ' * 300 + "no" + "price", "never | price " * 300 + "a b c d price"]
    args = (r"price", r"\bb\b"), ("not", "never"), ("far from",)
    found, outside = text.pattern_hit(F.col("t"), *args)
    out = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", found.alias("f"), outside.alias("o"))
    assert "substring(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: (r.f, r.o) for r in out.collect()} == {k: kernels.pattern_hit(t, args[0], frozenset(args[1]), args[2]) for k, t in enumerate(texts)}
