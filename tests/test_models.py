from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import models as M
from gleaner.operators import relational as R
from gleaner.operators import scoring as S
from gleaner.sources import files


def failing(words):
    """A model that fails on a batch with the word bad, and else scores by words."""

    def load():
        inner = M.word_share_model(words)

        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return inner(texts)

        return model

    return load


SIDES = {"up": ("good",), "down": ("poor",)}
LONG = " one two three four five six seven eight nine ten"


def test_stance_takes_named_lines_first_and_cuts(spark):
    named, generic, short = "Ann is good" + LONG, "the office is poor" + LONG, "Ann is poor"
    body = "\n".join([generic, short, named, generic, named])
    got = spark.createDataFrame([(body,)], "b string").select(M.stance_paragraphs(F.col("b"), ("ann",), r"\boffice\b").alias("p")).first().p
    assert got == [named, named, generic]  # lines that only refer once each, short lines not at all
    many = "\n".join(f"Ann {k}" + LONG for k in range(12))
    rows = spark.createDataFrame([(many,), (None,), ("Ann " + "w " * 600,)], "b string").select(M.stance_paragraphs(F.col("b"), ("ann",), r"\boffice\b").alias("p")).collect()
    assert len(rows[0].p) == M.MOST_PARAGRAPHS and rows[1].p == [] and len(rows[2].p[0].split()) == M.MOST_WORDS


def test_stance_is_null_without_paragraphs_or_scores(spark):
    df = spark.createDataFrame([(1, "Ann is good" + LONG), (2, "nobody"), (3, None), (4, "Ann is bad" + LONG)], "k int, b string").repartition(4, "k")
    got = {r.k: r.stance for r in M.stance(df, failing(SIDES), "b", ("ann",), r"\boffice\b", "up", "down").collect()}
    assert got[1] == pytest.approx(1 / 3) and got[2] is None and got[3] is None


def test_batches_that_fail_have_no_scores(spark):
    df = spark.createDataFrame([(1, ["good", "bad"]), (2, ["good"]), (3, [])], "k int, t array<string>").coalesce(1)
    got = {r.k: r.s for r in M.score_texts(df, failing(SIDES), "t", lambda x: x["up"], "s", batch=1).collect()}
    assert got == {1: pytest.approx(2 / 3), 2: pytest.approx(2 / 3), 3: None}


def test_signed():
    assert M.signed({"NEGATIVE": 0.9}) == -0.9 and M.signed({"Positive": 0.4}) == 0.4 and M.signed({"neutral": 1.0}) == 0


def test_document_sentiment_reads_the_first_words(spark):
    df = spark.createDataFrame([("x " * M.MOST_WORDS + "poor",), ("good poor good",), (None,)], "b string").coalesce(1)
    assert [r.sentiment for r in M.document_sentiment(df, lambda: M.polarity_model(("good",), ("poor",)), "b").collect()] == [0.0, pytest.approx(1 / 3), 0.0]


def test_frames_fall_back_to_patterns(spark):
    names = {"a": (r"\bgood\b",), "b": (r"\bpoor\b", r"\bodd\b")}
    df = spark.createDataFrame([(1, "Ann is good now."), (2, "poor thing"), (3, "nothing"), (4, "Ann is bad and odd."), (5, None)], "k int, b string")
    got = {r.k: (r.frame_a, r.frame_b, r.dominant_frame, r.frame_method) for r in M.frames(df, failing({"a": ("good",), "b": ("poor",)}), "b", ("ann",), names).collect()}
    assert got[1] == (pytest.approx(2 / 3), pytest.approx(1 / 3), "frame_a", "zeroshot")
    assert got[2] == (0.0, 0.5, "frame_b", "keyword_fallback")
    assert got[3] == (0.0, 0.0, None, "keyword_fallback") and got[5] == got[3]
    assert got[4] == (0.0, 0.5, "frame_b", "keyword_fallback")


def test_extraction_keeps_errors_and_stops_at_a_limit(spark):
    def load():
        def call(t):
            if "limit" in t:
                raise M.RateLimited("429")
            if "bad" in t:
                raise ValueError("refused")
            return [{"extraction_class": "c", "extraction_text": t.split()[-1], "attributes": {"n": str(len(t.split()))}}]

        return call

    rows = [(1, None, "a b"), (2, " ", "bad"), (3, None, None), (4, "w " * 4000, "x"), (1, None, "a b")]
    df = spark.createDataFrame(rows, "k int, full string, body string")
    got = {r.k: r for r in M.extract(df, load, "k", ["full", "body"]).collect()}
    assert got[1].n_extractions == 1 and got[1].extractions[0].extraction_text == "b" and got[1].error is None
    assert (got[2].n_extractions, got[2].error) == (0, "refused") and got[3].error == "empty_text"
    assert got[4].extractions[0].attributes == {"n": str(M.EXTRACT_WORDS)}
    limited = spark.createDataFrame([(k, "limit" if k == 3 else "ok") for k in range(6)], "k int, body string").coalesce(1)
    done = spark.createDataFrame([(0,)], "k int")
    kept = {r.k for r in M.extract(limited, load, "k", ["body"], done).collect()}
    assert 0 not in kept and 3 not in kept
    assert {r.k for r in M.extract(limited.where("k <> 3"), load, "k", ["body"], done).collect()} == {1, 2, 4, 5}


def test_extraction_keeps_keys_among_nulls_and_repeats(spark):
    """Whole numbers beyond 2 to the 53rd beside a null, a carried column, and rows of a repeated key."""
    rows = [(None, "a"), (2**53 + 1, "b"), (2**63 - 1, None), (7, "c"), (7, "d e")]
    df = spark.createDataFrame(rows, "k long, body string").withColumn("more", F.length("body")).coalesce(1)
    load = lambda: lambda t: [{"extraction_class": "c", "extraction_text": w, "attributes": {}} for w in t.split()]
    got = M.extract(df, load, "k", ["body"], once=False, carried=("more",)).select("k", "more", "n_extractions", "error").collect()
    assert {tuple(r) for r in got} == {(None, 1, 1, None), (2**53 + 1, 1, 1, None), (2**63 - 1, None, 0, "empty_text"), (7, 1, 1, None), (7, 3, 2, None)}
    assert sorted(r.k or 0 for r in M.extract(df, load, "k", ["body"]).collect()) == [0, 7, 2**53 + 1, 2**63 - 1]


@pytest.mark.parametrize("toxic", [[(3, 1), (4, 0), (None, 0), (5, None)], [(3, 1), (None, 1)], [(4, 0)]])
def test_extraction_equals_sql_on_odd_rows(spark, tmp_path, toxic):
    """Null, empty, blank and repeated texts, null ids, a vertical tab among over 3,000 words, and null ids among those left out."""
    import duckdb

    from gleaner.plans import catalog

    long = "w " * (M.EXTRACT_WORDS - 2)
    texts = ["license token", None, "", "  ", "\t", "\n", "token", "token", "stupid", long + "a\x0bb license", long + "a b license"]
    rows = [(k, t) for k, t in enumerate(texts, 1)] + [(7, "token token"), (None, "license"), (None, None), (-10, "token"), (2**53 + 1, "token")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(toxic, "doc_id long, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.sql(f"select doc_id, n_extractions, error from ({catalog.oracle_sql()['mdl07_extraction']})").fetchall()
    got = catalog.queries()["mdl07_extraction"](spark, str(tmp_path)).select("doc_id", "n_extractions", "error").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_notes(spark):
    notes = ["Low prosecutor relevance", "non-prosecutor", "not  mainly so", "wrong DA", "fine", None]
    df = spark.createDataFrame([(n,) for n in notes], "n string")
    assert [r[0] for r in df.select(M.note_flag(F.col("n"))).collect()] == [True, True, True, True, False, False]


def test_indicators_and_counters(spark):
    rows = [
        ("a", [("claim", {"evidence": " NONE", "blame": "Yes"}), ("loaded", {"target": "entity"}), ("loaded", {"target": "policy", "valence": "Favorable"}), ("imbalance", {"stance": "other"})]),
        ("b", [("loaded", {"target": "entity", "valence": "mixed"}), ("imbalance", None), ("imbalance", {"stance": "supportive"})]),
        ("c", []),
    ]
    df = spark.createDataFrame(rows, "k string, found array<struct<class:string,attributes:map<string,string>>>")
    flat = S.flat_extractions(df, "k", "found")
    got = {r.k: r for r in S.indicator_counts(flat, "k").collect()}
    assert (got["a"].n_total, got["a"].n_claims_severe, got["a"].n_blame, got["a"].n_loaded_negative, got["a"].n_loaded_favorable) == (4, 1, 1, 1, 1)
    assert (got["b"].n_loaded_negative, got["b"].n_supportive) == (1, 1) and got["c"].n_total == 0
    assert {r.reason: r.n for r in S.quality_counters(flat).collect()} == {"legacy_no_valence": 1, "unmapped_stance_other": 1, "unmapped_valence_mixed": 1, "unmapped_stance_missing": 1}


def test_validation_and_labels(spark):
    df = spark.createDataFrame([(1, "Not Sure", "x"), (2, "yes", "2.0"), (3, "maybe", None)], "k int, a string, b string")
    kept, rejected = R.validated(df, {"a": ["yes", "not_sure"], "b": ["2"]}, text.fold_label)
    assert [tuple(r) for r in kept.orderBy("k").collect()] == [(1, "not_sure", ""), (2, "yes", "2"), (3, "", "")]
    assert {(r["column"], r.value): r.n for r in rejected.collect()} == {("a", "maybe"): 1, ("b", "x"): 1}
    packets = spark.createDataFrame([("p1", 1), ("p2", 2), ("p3", 3), (None, 4)], "packet string, k int")
    keys = spark.createDataFrame([("p1", "key"), ("p2", " ")], "packet string, l string")
    corpus = spark.createDataFrame([(1, "one"), (2, "two"), (4, "four")], "k int, l string")
    assert {r.k: r.l for r in R.labelled(packets, keys, corpus, "packet", "k", "l").collect()} == {1: "key", 2: "two", 3: None, 4: "four"}


def test_pull_halves_retries_and_repairs(spark):
    start = datetime(2024, 1, 1)

    def load():
        tried = set()

        def call(a, b):
            if (a, b) not in tried:
                tried.add((a, b))
                raise TimeoutError
            hours = [h for h in range(48) if a <= start + timedelta(hours=h) < b]
            return '{"articles": [' + ", ".join(f'{{"url": "u{h % 40}", "seen": {h}, "t": "a\x02b"}}' for h in hours[:10]) + "]}"

        return call

    windows = spark.createDataFrame([(start, start + timedelta(days=1)), (start + timedelta(days=1), start + timedelta(days=2))], "start timestamp_ntz, stop timestamp_ntz")
    got = files.pull(windows, load, "url string, seen long, t string", cap=10, wait=lambda k: 0).collect()
    assert sorted((r.url, r.seen, r.t) for r in got) == sorted((f"u{h}", h, "a b") for h in range(40))
    with pytest.raises(Exception, match="TimeoutError|ConnectionError|OSError"):
        files.pull(windows, lambda: lambda a, b: (_ for _ in ()).throw(TimeoutError()), "url string, seen long", tries=2, wait=lambda k: 0).collect()
    assert files.repaired_json("<html>") == {} and [files.backoff(k) for k in (0, 1, 9)] == [10, 20, 120]


def test_a_shared_folder_is_asked_for_outside_of_local_mode():
    class Context:
        master = "spark://host:7077"

    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

        sparkContext = Context  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.scratch(Session, "x")


def test_stance_query_reads_whole_lines(spark, tmp_path):
    """A line's words behind the 512th count as in the query's SQL, which cuts none."""
    import duckdb

    from gleaner.plans.registry import SQL, QUERIES
    import gleaner.plans.catalog  # noqa: F401  registers

    rows = [(1, "that " + "x " * 600 + "the and the"), (2, "that" + LONG + " was"), (3, "nothing"), (4, None)]
    rows += [(10 + k, "that" + " the" * up + " was" * down + " x" * 20) for k, (up, down) in enumerate((a, 637 - a) for a in range(2, 636))]  # shares of 640: halves at the seventh digit
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.stance for r in QUERIES["mdl03_stance"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(SQL["mdl03_stance"]).fetchall()) and got[1] == 0.5
