import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, Entity
from gleaner.functions import kernels, scalars, text
from gleaner.operators import relational as R
from gleaner.operators import sampling as P
from gleaner.operators import scoring as S
from gleaner.sources import files
from gleaner.streaming import jobs


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("x")).first().x


def test_sentences_and_windows(spark):
    t = 'First one. Second with target! "Third" now? fourth. Fifth.'
    assert one(spark, t, text.sentences) == ["First one.", "Second with target!", '"Third" now? fourth.', "Fifth."]
    assert one(spark, t, lambda c: text.windows(c, r"\btarget\b", 3)) == ['First one. Second with target! "Third" now? fourth.']
    assert one(spark, None, lambda c: text.windows(c, "a", 3)) == []


def test_clean_and_words(spark):
    assert one(spark, " It’s  “Odd”\r\n ", text.clean) == "it's \"odd\""
    assert one(spark, "a  b c", lambda c: text.first_words(c, 3)) == "a  b c"
    assert one(spark, "a  b c d", lambda c: text.first_words(c, 3, " ...")) == "a b c ..."
    assert one(spark, None, text.word_count) == 0


def test_keyword_boundaries(spark):
    assert one(spark, "Da mihi: the DA said", lambda c: text.keyword_score(c, ["da ", "da", "said"])) == 3
    assert one(spark, "panda ", lambda c: text.keyword_score(c, ["da", "da "])) == 0


def test_negation_and_quotes():
    negators = frozenset(("not", "never"))
    assert not kernels.pattern_hit("it was not the plan", ["plan"], negators)[0]
    assert kernels.pattern_hit("not one two three four plan", ["plan"], negators) == (True, True)
    assert kernels.pattern_hit('he said "the plan" here', ["plan"], negators) == (True, False)
    assert kernels.pattern_hit('"the plan" and a plan', ["plan"], negators) == (True, True)
    assert not kernels.pattern_hit("far from any plan", ["plan"], negators, ("far from",))[0]


def test_gated_mentions():
    assert kernels.gated_mentions("Price rose; court met. " + "x " * 400 + "price", "price", r"\bcourt\b") == 1
    assert kernels.gated_mentions("In court Ann Price and Price", "price", r"\bcourt\b", name="ann") == 0


def test_centrality_bounds():
    r = kernels.centrality("Target wins", "The target said no. Target left. Others came.", r"\btarget\b")
    assert r[0] == r[1] == 1 and all(0 <= x <= 1 for x in r)
    assert kernels.centrality("", "", "x") == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_interval_lookup_edges(spark):
    dim = R.entity_table(spark, type(DEFAULT)(entities=(Entity("a", "n", "A", "2020-01-01", "2020-06-30", ("a",)), Entity("b", "n", "B", "2020-07-01", None, ("b",)))))
    rows = [("n", dt.date(2020, 6, 30)), ("n", dt.date(2020, 7, 1)), ("n", dt.date(2019, 1, 1)), ("s", dt.date(2020, 7, 1)), (None, dt.date(2020, 7, 1)), ("n", None)]
    got = R.interval_lookup(spark.createDataFrame(rows, "region string, day date"), dim, ["region"], "day").collect()
    assert {(r.region, r.day): r.found for r in got} == dict(zip(rows, ["a", "b", None, None, None, None], strict=True))


def test_composite_renormalises(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (None, -1.0, None, None), (None,) * 4, (-0.1, 0.0, None, None)], "aspect double, stance double, keywords double, document double")
    mean, n = S.composite({k: F.col(k) for k in DEFAULT.weights}, DEFAULT)
    got = df.select(mean.alias("m"), n.alias("n")).collect()
    assert [r.m for r in got[:3]] == [1.0, -1.0, None] and [r.n for r in got] == [0, 1, 0, 0]
    assert got[3].m == pytest.approx(-0.035 / 0.65)


def test_primary_entity_ties_and_vetoes(spark):
    df = spark.createDataFrame([(1, "this and that", "")], "k int, body string, head string")
    m = S.mention_array(df, DEFAULT, "body", "head")
    assert m.select(S.primary_entity(F.col("mentions")).alias("e")).first().e == "that"
    assert m.select(S.primary_entity(F.col("mentions"), F.array(F.lit("that"))).alias("e")).first().e == "this"
    assert S.mention_array(df.withColumn("body", F.lit(None).cast("string")), DEFAULT, "body", "head").select(S.primary_entity(F.col("mentions")).alias("e")).first().e is None


def test_theme_validation_rounds_half_even(spark):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in (("dict", 0.125 / 0.3), ("regex", 0.0), ("crit", 0.0), ("cooc", 0.0))))
    score, n, confidence = S.validate_themes({k: F.col(k) for k in DEFAULT.theme_weights}, DEFAULT)
    r = row.select(score.alias("s"), n.alias("n"), confidence.alias("c")).first()
    assert (r.n, r.c) == (1, "Low") and r.s in (0.12, 0.13)


def test_failing_model_gives_null(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return [1.0] * len(texts)

        return model

    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "t string").coalesce(1)
    assert [r.s for r in S.apply_model(df, load, "t", "s", batch=1).collect()] == [1.0, None, 1.0]


def test_latest_success(spark):
    rows = [("a", None, 1, "x"), ("a", "e", 2, "y"), ("b", "e", 1, "z"), ("b", "e", 3, "w"), ("c", None, 1, "u"), ("c", None, 2, "v")]
    got = R.latest_success(spark.createDataFrame(rows, "id string, error string, seq int, v string"), "id", "error", "seq").collect()
    assert {r.id: r.v for r in got} == {"a": "x", "b": "w", "c": "v"}


def test_dense_id_over_partitions(spark):
    got = R.dense_id(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(5), ["v"], "n").collect()
    assert all(r.v == r.n for r in got) and len(got) == 1000


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    for f in (lambda d: P.uniform(d, "id", 20), lambda d: P.stratified(d, "id", "g", 5)):
        assert {r.id for r in f(df).collect()} == {r.id for r in f(df.repartition(9)).collect()}
    o = P.overlap(df, "id", ["x", "y"], 10, 7).collect()
    own = [r.id for r in o if not r.overlap_set]
    assert len(o) == 34 and len(set(own)) == 14 and not set(own) & {r.id for r in o if r.overlap_set}
    with pytest.raises(ValueError):
        P.assert_blind(df, ["g"])


def test_tsv_short_and_long_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('A\tB\tC\n1\t"x ""q""\ny"\tz\n2\tshort\n3\ta\tb\ttoo many\n4\tNA\tend\n')
    got = files.na_to_null(files.read_tsv(spark, str(tmp_path / "a.tsv"), ["a", "b", "c"])).collect()
    assert [tuple(r) for r in got] == [("1", 'x "q"\ny', "z"), ("2", "short", None), ("4", None, "end")]
    with pytest.raises(ValueError):
        files.clean_headers(spark.createDataFrame([(1,)], "body int"), ["date"])


ODD = [None, "", " ", " a", "a ", "\ta\t", "\n\na\n", "\r", "a\r", "\r\n", "a\x00", "\x01", "NA", "nan", "null", "None", "<NA>", "NA ", "\\N", "\\", '"', '""', '"a"', 'a\\"', '"\n"', '"\t"', "#", "plain"]


@pytest.mark.parametrize("name", ["src01_src03_tsv_scan", "snk02_csv"])
def test_separated_files_keep_odd_values(spark, tmp_path, name):
    """Null and empty values, white space around values, marks of missing ones, line ends, quotes and backslashes."""
    import duckdb

    from gleaner.plans import catalog

    table, columns = ("documents", "doc_id long, text string, source string") if name != "snk02_csv" else ("customer", "c_custkey long, c_name string, c_mktsegment string")
    rows = [(None if k == 7 else k, a, b) for k, (a, b) in enumerate((a, b) for a in ODD for b in ODD)]
    spark.createDataFrame(rows, columns).coalesce(2).write.parquet(str(tmp_path / f"{table}.parquet"))
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = db.sql(catalog.oracle_sql()[name]).fetchall()
    got = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert len(want) == len(ODD) ** 2 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_encodings_and_config(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.csv").write_bytes("﻿é".encode())
    (tmp_path / "u" / "b.csv").write_bytes(b"\xe9\x80")
    assert sorted(r.text for r in files.read_csv_any_encoding(spark, str(tmp_path / "u")).collect()) == ["é", "é€"]
    (tmp_path / "c.json").write_text('{"a": {"b": 3}}')
    assert tuple(files.read_config(spark, str(tmp_path / "c.json"), {"x": "$.a.b", "y": "$.q"}, "none").first()) == ("3", "none")


def test_tolerant_json_and_vocabulary(spark):
    for given, want in (('{"a": "1"}', {"a": "1"}), ('"a": "1"', {"a": "1"}), ("a: 1, b = two", {"a": "1", "b": "two"}), ("", None)):
        assert one(spark, given, text.tolerant_json) == want
    m = F.create_map(F.lit("k"), F.lit("v"), F.lit("z"), F.lit("q"))
    assert spark.range(1).select(text.closed_vocabulary(m, {"k": ["v"], "z": ["r"]}).alias("x")).first().x == "k=v"


def test_scalars(spark):
    r = spark.range(1).select(scalars.ratio(F.lit(1.0), F.lit(0.0)).alias("a"), scalars.ratio(F.lit(0.0), F.lit(0.0)).alias("b"), scalars.wilson(F.lit(0), F.lit(10))[1].alias("c"), scalars.wilson(F.lit(0), F.lit(0))[0].alias("d")).first()
    assert r.a == float("inf") and r.b is None and r.c == pytest.approx(0.27753279) and r.d is None


def test_streamed_scores_equal_batch_and_resume(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.createDataFrame([("a", None, 1), ("b", "e", 1)], "id string, error string, seq int").write.parquet(f"{src}/1")
    read = lambda: spark.readStream.schema("id string, error string, seq int").parquet(f"{src}/*")
    jobs.append_records(read(), lambda d: d, out, check).awaitTermination()
    spark.createDataFrame([("b", None, 2)], "id string, error string, seq int").write.parquet(f"{src}/2")
    jobs.append_records(read(), lambda d: d, out, check).awaitTermination()
    got = jobs.current(spark, out, "id", "error", "seq").collect()
    assert {r.id: r.error for r in got} == {"a": None, "b": None} and spark.read.parquet(out).count() == 3
    assert [r.id for r in jobs.pending(spark.createDataFrame([("a",), ("z",)], "id string"), spark.read.parquet(out), "id").collect()] == ["z"]


def test_rounding_is_that_of_the_sql(spark):
    """Halves at the seventh digit, products past 2 to the 53rd and values that are no numbers, as DuckDB rounds them."""
    import duckdb

    from gleaner.plans.registry import rounded_as_sql

    con = duckdb.connect()
    ties = [(2 * k + 1) / 2e7 * m for k in range(0, 40000, 7) for m in (1, 10, 1 / 3)]
    values = [*ties, 1436029418121313.1, 9019661319359314.0 / 3, 1e300, -0.25, -1.0000005, float("inf"), float("-inf"), 0.0, None]
    con.execute("create table t (k bigint, v double)")
    con.executemany("insert into t values (?, ?)", list(enumerate(values)))
    want = dict(con.execute("select k, round(v, 6) + 0.0 from t").fetchall())
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double").coalesce(1)
    got = {r.k: r.r for r in df.select("k", (rounded_as_sql(F.col("v")) + 0.0).alias("r")).collect()}
    assert got == want
    assert any(r.r != want[r.k] for r in df.select("k", (F.round("v", 6) + 0.0).alias("r")).collect())
