import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import density
from gleaner.operators import relational as R
from gleaner.operators import sampling as P
from gleaner.plans import views
from gleaner.sources import files, report
from gleaner.streaming import jobs


def test_interval_join_equals_the_lookup(spark):
    """Short, long, open, one-day, reversed and overlapping intervals, ties of order, null keys and dates, repeated facts."""
    rng, day = random.Random(1), dt.date(2020, 1, 1)
    dim = []
    for k in range(300):
        a = day + dt.timedelta(rng.randrange(900))
        length = rng.choice([0, 1, 3, 30, 400, 4000, -2])
        dim.append((rng.choice(["a", "b", "hot", "hot", "hot"]), f"n{k}", a, None if rng.random() < 0.02 else a + dt.timedelta(length), rng.randrange(100)))
    dim += [("a", "null start", None, day, 0), (None, "null key", day, None, 0), ("b", "far", dt.date(1900, 1, 1), dt.date(9999, 12, 31), 99)]
    facts = [(k, rng.choice(["a", "b", "hot", "none", None]), rng.choice([None, *[day + dt.timedelta(rng.randrange(-50, 1000))] * 9])) for k in range(400)] + [(1, "hot", day)] * 3
    d = spark.createDataFrame(dim, "k string, name string, start date, end date, ord int")
    f = spark.createDataFrame(facts, "id int, k string, day date")
    want = R.interval_lookup(f, d.where("name <> 'null start'"), ["k"], "day")
    got = R.interval_join(f.repartition(3), d, ["k"], "day")

    def first(k, at):
        held = [(o, n) for key, n, a, b, o in dim if a and key == k and at and a <= at <= (b or dt.date(9999, 12, 31))]
        return min(held)[1] if held and k else None

    assert sorted(map(repr, got.collect())) == sorted(map(repr, (type(got.first())(id=i, k=k, day=at, found=first(k, at)) for i, k, at in facts)))
    assert want.count() == got.count() and R.interval_join(f, d.limit(0), ["k"], "day").where("found is not null").count() == 0
    assert R.interval_join(f.limit(0), d, ["k"], "day").count() == 0


def test_ranges_of_dense_ids_are_dealt_once(spark):
    out = R.dense_id(spark.range(5000).select((F.xxhash64("id") % 50).alias("v"), F.col("id").alias("k")), ["v", "k"])
    assert [r.id for r in out.orderBy("v", "k").collect()] == list(range(5000))
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_density_against_the_direct_sum(spark):
    rng = np.random.default_rng(2)
    xy = rng.multivariate_normal([0.2, -0.1], [[1.0, 0.5], [0.5, 0.6]], 3000)
    rows = [("a", float(x), float(y)) for x, y in xy] + [("few", 0.0, 1.0)] * 10 + [("flat", 1.0, float(k)) for k in range(80)] + [("a", None, 1.0), ("a", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(4)
    got = density.kernel_density(df, "g", "x", "y", (-3.0, 3.0), (-2.0, 2.0), cells=40).collect()
    assert {r.g for r in got} == {"a"} and len(got) == 1600
    z = np.zeros((40, 40))
    for r in got:
        z[r.i, r.j] = r.density
    cov = np.cov(xy.T) * 0.09
    inverse, norm = np.linalg.inv(cov), 3000 * 2 * np.pi * np.sqrt(np.linalg.det(cov))
    xs, ys = np.linspace(-3, 3, 40), np.linspace(-2, 2, 40)
    for i in range(0, 40, 3):
        for j in range(0, 40, 3):
            d = np.array([xs[i], ys[j]]) - xy
            assert z[i, j] == pytest.approx(np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, inverse, d)).sum() / norm, abs=1e-3 * z.max())
    bins = density.binned(df, "g", "x", "y", (-3.0, 3.0), (-2.0, 2.0), 40, 0.3, 1, 51)
    assert bins.count() < 3000 and bins.agg(F.sum("n")).first()[0] == 3000


def test_counted_loads(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('a\tb\n1\t"x\ny"\n2\n3\tq\tmore\n4\tz\n')
    rows, counts = files.read_tsv_counted(spark, str(tmp_path / "t.tsv"), ["a", "b"])
    assert counts == {"read": 4, "long": 1, "kept": 3} and sorted((r.a, r.b) for r in rows.collect()) == [("1", "x\ny"), ("2", None), ("4", "z")]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n{"a": ')
    rows, counts = files.read_jsonl_counted(spark, str(tmp_path / "j.jsonl"), "a long")
    assert counts == {"read": 4, "corrupt": 2, "kept": 2} and sorted(r.a for r in rows.collect()) == [1, 2]
    rows, counts = files.dated(spark.createDataFrame([("2020-01-02",), ("never",), (None,)], "d string"), "d", "ts")
    assert counts == {"read": 3, "undated": 2, "kept": 1} and rows.columns == ["d", "ts"]
    assert files.dated(spark.createDataFrame([], "d string"), "d", "ts")[1] == {"read": 0, "undated": 0, "kept": 0}


def test_winners_over_triggers_and_a_restart(spark, tmp_path):
    """Changes of a stream that stops and goes on equal the batch aggregate at every stop; microseconds and nulls survive."""
    rng, schema = random.Random(6), "k string, seq long, error string, v double, ts timestamp_ntz"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows, seq = [], 0
    for turn in range(3):
        for part in range(2):
            new = []
            for _ in range(30):
                seq += 1
                new.append((f"k{rng.randrange(12)}", seq if turn != 1 else seq - 70, rng.choice([None, "bad"]), rng.choice([None, 1.5]), dt.datetime(2024, 1, 1, 0, 0, 0, seq)))
            rows += new
            spark.createDataFrame(new, schema).coalesce(1).write.parquet(f"{source}/{turn}{part}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        jobs.append_changes(jobs.winners(stream, "k", "error", "seq"), out, checkpoint).awaitTermination()
        best = {}
        for r in rows:
            at = (r[2] is None, r[1])
            if r[0] not in best or at > best[r[0]][0]:
                best[r[0]] = at, r
        got = {r.k: (r.k, r.seq, r.error, r.v, r.ts) for r in jobs.latest(spark, out, "k").select("k", "seq", "error", "v", "ts").collect()}
        assert got == {k: r for k, (_, r) in best.items()}


def test_report_is_whole_and_ordered_or_absent(spark, tmp_path):
    uri = f"file://{tmp_path}/deep/r.md"
    df = spark.range(1000).repartition(5).select(F.concat(F.lit("line é "), F.col("id").cast("string")).alias("t"), "id")
    report.write_report(df, "t", ["id"], uri, head="# head\n", tail="end\n")
    want = "# head\n" + "".join(f"line é {k}\n" for k in range(1000)) + "end\n"
    assert (tmp_path / "deep/r.md").read_text() == want
    bad = df.withColumn("t", F.when(F.col("id") == 777, F.raise_error(F.lit("stop"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="stop"):
        report.write_report(bad, "t", ["id"], uri)
    with pytest.raises(Exception, match="stop"):
        report.write_report(bad, "t", ["id"], f"file://{tmp_path}/deep/new.md")
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["r.md"] and (tmp_path / "deep/r.md").read_text() == want
    report.write_report(df.limit(0), "t", ["id"], uri, head="empty")
    assert (tmp_path / "deep/r.md").read_text() == "empty"
    with pytest.raises(Exception, match="string"):
        df.write.format("report").mode("overwrite").option("path", uri).save()
    with pytest.raises(Exception, match="r.md"):
        df.select("t").write.format("report").mode("append").option("path", uri).save()


def test_buckets_in_one_scan(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, rng.randrange(60)) for k in range(500)]
    spark.createDataFrame(rows, "k long, v int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rules = [(f"b{j}", F.col("v") % (j + 2) == 0, 7 + j) for j in range(10)] + [("none", F.lit(False), 3), ("rest", F.lit(True), 1000)]
    out = P.buckets(df, "k", rules)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    order = [r.k for r in df.orderBy(P.draw_order("k", 42), "k").collect()]
    values, took, want = dict(rows), set(), []
    for j, (name, _, n) in enumerate(rules):
        mine = [k for k in order if k not in took and (name == "rest" or (name != "none" and values[k] % (j + 2) == 0))][:n]
        took |= set(mine)
        want += [(name, k) for k in mine]
    assert sorted((r.bucket, r.k) for r in out.collect()) == sorted(want)


def test_functions_have_sql_text(spark):
    views.register_functions(spark)
    r = spark.sql("select clean_text(' A  ‘b’ ') as a, stance_bucket(-0.5D) as b, region_of('src12') as c, frame_technical('token |') as d, mentions_was('Was, were; wash') as e, cohen_h(0.5D, 0.5D) as f").first()
    assert (r.a, r.b, r.c, r.e, r.f) == ("a 'b'", "critical", "north", 2, 0) and r.d == pytest.approx(2 / 3)
    from gleaner.functions import text

    with pytest.raises(ValueError, match="lambda"):
        views.sql_of(spark, text.word_count, {"t": "string"})


def test_interval_join_meets_blocks_not_intervals(spark):
    """No join compares dates with intervals: many long ones over a date give it one row a block, by equality alone."""
    day = dt.date(1969, 12, 1)
    dim = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("name"), F.date_add(F.lit(day), (F.col("id") % 40).cast("int")).alias("start"), F.date_add(F.lit(day), (40 + F.col("id") % 77).cast("int")).alias("end"), (-F.col("id")).alias("ord"))
    facts = spark.range(130).select(F.lit("hot").alias("k"), F.date_add(F.lit(day), (F.col("id") - 5).cast("int")).alias("day"))
    out = R.interval_join(facts, dim, ["k"], "day")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any("<=" in line or ">=" in line for line in plan.splitlines() if "Join" in line)
    want = {d: max((k for k in range(2000) if k % 40 <= d <= 40 + k % 77), default=None) for d in range(-5, 125)}
    assert {(r.day - day).days: r.found for r in out.collect()} == want


def test_winners_are_an_aggregate_and_only_changes_come(spark, tmp_path):
    """Rows combine in the JVM before the shuffle; a trigger writes the keys whose winner is new, and equal numbers change none."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k string, seq long, error string, v double"
    batches = [[("a", 1, None, 1.0), ("b", 1, "bad", 2.0)], [("a", 1, None, 9.0), ("a", 5, "bad", 9.0), ("b", 0, None, 3.0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{n}")
        changes = jobs.winners(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source), "k", "error", "seq")
        assert "Pandas" not in changes._jdf.queryExecution().analyzed().toString()
        jobs.append_changes(changes, out, checkpoint).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("batch", "k", "v").collect()) == [(0, "a", 1.0), (0, "b", 2.0), (1, "b", 3.0)]
