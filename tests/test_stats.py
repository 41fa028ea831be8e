import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import tails
from gleaner.operators import stats as A

#: Published results of a study, as moments, tables and what its tests gave.
N1, MEAN1, SD1, N2, MEAN2, SD2 = 6585, 1.6891647684130602, 2.9945398267059615, 6242, 0.6709708426786286, 1.6508389401537786
T, D, P = 24.009908261883076, 0.4181313326713896, 5.145500946678921e-124
TABLE = {"A": [4868, 1020, 2795, 13752, 4176, 5104, 3002, 3187, 2869, 804], "B": [4456, 932, 3557, 16166, 2629, 4275, 1858, 2223, 1136, 977]}
CHI2 = 1802.1093791316816
YATES = [((1206, 256), 639.6044162908103, 4.465553815489749), ((18, 3), 8.619882104077423, 5.6874715261959)]


def test_welch_and_cohen_from_published_moments(spark):
    m = spark.createDataFrame([(N1, MEAN1, SD1**2, N2, MEAN2, SD2**2)], "n1 long, mean1 double, var1 double, n2 long, mean2 double, var2 double")
    r = A.finish_contrast(m).first()
    assert r.t == pytest.approx(T, rel=1e-12) and r.d == pytest.approx(D, rel=1e-12)
    assert r.p == pytest.approx(P, rel=1e-8) and tails.t_two_sided(r.t, r.df) == pytest.approx(P, rel=1e-8)


def test_chi2_of_published_table(spark):
    rows = [(g, k, n) for g, counts in TABLE.items() for k, n in enumerate(counts)] + [("A", 99, 0), (None, 1, 5)]
    r = A.chi2(spark.createDataFrame(rows, "g string, k int, n long"), "g", "k").first()
    assert r.chi2 == pytest.approx(CHI2, rel=1e-10) and r.dof == 9


@pytest.mark.parametrize("counts, stat, ratio", YATES)
def test_yates_of_published_counts(spark, counts, stat, ratio):
    rows = [(i < c, True) for c, n in [(counts[0], N1)] for i in range(n)] + [(i < counts[1], False) for i in range(N2)]
    r = A.two_by_two(spark.createDataFrame(rows, "hit boolean, one boolean"), F.col("hit"), F.col("one"), []).first()
    assert r.chi2 == pytest.approx(stat, rel=1e-10)
    assert (counts[0] / N1) / (counts[1] / N2) == pytest.approx(ratio)


def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert tails.f_upper(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-8)
    assert tails.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    odds, p = tails.fisher_exact(8, 2, 1, 5)
    assert odds == 20 and p == pytest.approx(0.03496503496503495)


def test_bh_monotone_and_null(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, None]
    got = {r.p: r.p_bh for r in A.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "k int, p double"), "p").collect()}
    assert got[None] is None
    assert [got[p] for p in sorted(p for p in ps if p is not None)] == pytest.approx([0.025, 0.025, 0.05, 0.05, 0.5])


def test_rank_test_equals_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(float(rng.integers(0, 9)), bool(rng.integers(0, 2))) for _ in range(300)]
    r = A.rank_test(spark.createDataFrame(rows, "v double, g boolean"), "v", F.col("g")).first()
    a, b = [v for v, g in rows if g], [v for v, g in rows if not g]
    pairs = sum((x > y) - (x < y) for x in a for y in b) / (len(a) * len(b))
    assert r.delta == pytest.approx(pairs) and r.auc == pytest.approx((pairs + 1) / 2)


def test_kappa(spark):
    rows = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [(None, "a"), ("z", "z")]
    r = A.kappa(spark.createDataFrame(rows, "x string, y string"), "x", "y", ["a", "b"]).first()
    assert r.n == 50 and r.kappa == pytest.approx(0.4)


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(float(i % 7), float(rng.normal()), i % 5) for i in range(200)]
    df = spark.createDataFrame([(1.0, x, 2 + 3 * x + e, c) for x, e, c in rows], "const double, x double, y double, c int")
    fit = {r["term"]: r for r in A.ols_clustered(df, "y", ["const", "x"], "c")}
    x = np.array([[1, r[0]] for r in rows])
    y = np.array([2 + 3 * r[0] + r[1] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert [fit["const"]["coef"], fit["x"]["coef"]] == pytest.approx(list(beta))
    assert 0 <= fit["x"]["p"] < 1e-6 and fit["x"]["low"] < 3.1 < fit["x"]["high"] + 0.5


def test_segmented_recovers_a_step_and_refuses_short_series(spark):
    rows = [(f"20{20 + k // 12}-{k % 12 + 1:02d}-15", 1.0 + 0.1 * k + (5 if k >= 10 else 0) + (0.5 * (k - 10) if k >= 10 else 0) + 0.001 * (k % 3)) for k in range(24)]
    df = spark.createDataFrame(rows, "d string, v double").withColumn("d", F.to_date("d"))
    design = A.its_design(A.monthly(df, "d", "v"), "2020-11-20").collect()
    r = A.segmented(design)
    assert r["post"] == pytest.approx(5, abs=0.01) and r["time_after"] == pytest.approx(0.5, abs=0.01) and r["horizon"] == 12
    assert r["effect_at_horizon"] == pytest.approx(r["post"] + 12 * r["time_after"])
    assert A.glsar(design)["post"] == pytest.approx(5, abs=0.01)
    assert A.segmented([d for d in design if d.time < 15])["status"] == "too few months"


def test_bootstraps(spark):
    df = spark.createDataFrame([(k, float(k % 10), k % 2, k % 6) for k in range(400)], "k int, v double, g int, c int")
    c = A.cluster_bootstrap(df, "c", "v", F.col("g") == 1, 200)
    assert c["n_clusters"] == 6 and math.isfinite(c["difference"])


def test_tost():
    r = A.tost(1000, 0.0, 1.0, 1000, 0.01, 1.0)
    assert r["equivalent"] and not A.tost(20, 0.0, 1.0, 20, 1.0, 1.0, welch=True)["equivalent"]


def test_t_quantile():
    from gleaner.functions import tails

    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281388519649, rel=1e-9)
    assert tails.t_quantile(0.975, 1e6) == pytest.approx(1.95996, abs=1e-4)


def test_weights_do_not_depend_on_place_and_have_mean_and_variance_one():
    import numpy as np

    keys = np.arange(5000, dtype="i8") * 7919
    w = A.weights_of(keys, 200)
    assert (w[100:103] == A.weights_of(keys[100:103], 200)).all()
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)


def test_bootstrap_contrast_against_rows(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k, float(x), bool(g)) for k, (x, g) in enumerate(zip(rng.normal(0, 1, 600) + np.repeat([0.5, 0.0], 300), np.repeat([True, False], 300), strict=True))]
    df = spark.createDataFrame([*rows, (9999, None, True), (9998, 1.0, None)], "k long, v double, g boolean")
    got = {r.statistic: r for r in A.bootstrap_contrast(df, "v", F.col("g"), "k", 800).collect()}
    again = {r.statistic: r for r in A.bootstrap_contrast(df.repartition(5), "v", F.col("g"), "k", 800).collect()}
    x, y = (np.array([v for _, v, g in rows if g == side]) for side in (True, False))
    draws = [(a := rng.choice(x, 300)).mean() - (b := rng.choice(y, 300)).mean() for _ in range(800)]
    assert got["difference"].estimate == pytest.approx(x.mean() - y.mean())
    for r, k in ((got["difference"].low, 2.5), (got["difference"].high, 97.5)):
        assert r == pytest.approx(np.percentile(draws, k), abs=0.05)
    assert got["d"].low < got["d"].estimate < got["d"].high
    assert all(got[s].low == pytest.approx(again[s].low) for s in got)


def test_kappa_and_proportion_intervals(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    a = rng.choice(["x", "y", "z"], 400)
    b = np.where(rng.random(400) < 0.7, a, rng.choice(["x", "y", "z"], 400))
    df = spark.createDataFrame([*zip(a.tolist(), b.tolist(), strict=True), ("other", "x"), (None, "x")], "a string, b string")
    got = A.kappa_ci(df, "a", "b", ["x", "y", "z"], 1000)

    def kappa(p, q):
        agree = (p == q).mean()
        chance = sum((p == k).mean() * (q == k).mean() for k in "xyz")
        return (agree - chance) / (1 - chance)

    draws = [kappa(a[i], b[i]) for i in rng.integers(0, 400, (1000, 400))]
    assert got["n"] == 400 and got["kappa"] == pytest.approx(kappa(a, b))
    assert got["low"] == pytest.approx(np.percentile(draws, 2.5), abs=0.02) and got["high"] == pytest.approx(np.percentile(draws, 97.5), abs=0.02)
    assert math.isnan(A.kappa_ci(df.limit(3), "a", "b", ["x", "y", "z"])["low"])
    low, high = A.proportion_ci(30, 100, 4000)
    assert low == pytest.approx(0.21, abs=0.02) and high == pytest.approx(0.39, abs=0.02)
    assert math.isnan(A.proportion_ci(1, 1)[0])


def test_glsar_finds_rho_and_its_inference_matches_the_normal_equations(spark):
    import datetime as dt
    import random

    from pyspark.sql import Row

    rng, e, rows = random.Random(4), 0.0, []
    for k in range(400):
        e = 0.6 * e + rng.gauss(0, 1)
        post = int(k >= 200)
        rows.append(Row(month=dt.date(1900, 1, 1) + dt.timedelta(31 * k), mean=5 + 0.01 * k + 2 * post + 0.02 * post * (k - 200) + e, n=1, time=k, post=post, time_after=post * (k - 200)))
    r = A.glsar(rows)
    assert r["rho"] == pytest.approx(0.6, abs=0.1) and r["durbin_watson"] == pytest.approx(2, abs=0.2) and r["horizon"] == 12
    assert r["effect_at_horizon"] == pytest.approx(r["post"] + 12 * r["time_after"])
    assert r["low_post"] < r["post"] < r["high_post"] and 0 <= r["p_post"] <= 1
    assert A.glsar(rows[:203])["status"] == "too few months"


def test_ranks_and_adjusted_p_values_against_rows(spark):
    rows = [(g, v, p) for g, v, p in [("a", 1.0, 0.01), ("a", 2.0, 0.02), ("a", 2.0, 0.02), ("a", None, None), (None, 3.0, 0.5), (None, 1.0, 0.04), ("a", 5.0, 0.9)]]
    df = spark.createDataFrame(rows, "g string, v double, p double")
    got = {(r.g, r.v): r.k for r in A.average_rank(df, "v", "k", ["g"]).collect()}
    assert got == {("a", 1.0): 1, ("a", 2.0): 2.5, ("a", None): None, ("a", 5.0): 4, (None, 1.0): 1, (None, 3.0): 2}
    adjusted = sorted((r.p, r.p_bh) for r in A.benjamini_hochberg(df.where("g = 'a'"), "p").where("p is not null").collect())
    assert [b for _, b in adjusted] == pytest.approx([0.02 * 4 / 3, 0.02 * 4 / 3, 0.02 * 4 / 3, 0.9])


def test_agreement_leaves_blanks_out(spark):
    pairs = spark.createDataFrame([(1, "a", "b", "x", "x"), (2, "a", "b", "x", " y "), (3, "a", "b", "", "y"), (4, "a", "b", None, "y")], "packet int, coder_a string, coder_b string, f_a string, f_b string")
    table, differ = A.agreement(pairs, ["f"])
    assert [tuple(r) for r in table.collect()] == [("a", "b", "f", 2, 1, 0.5)]
    assert [(r.packet, r.value_a, r.value_b) for r in differ.collect()] == [(2, "x", "y")]


def test_tail_columns_equal_the_scalar_functions(spark):
    from gleaner.functions import distributions as D

    ts = [(float(t), float(df)) for t in (0.0, 1e-6, -0.3, 0.7, 1.5, -2.2, 4.0, 9.0, 24.0, 80.0) for df in (0.7, 1, 2, 3.5, 10, 29, 100, 1234.5, 1e5, 1e6)]
    for r in spark.createDataFrame(ts, "t double, df double").select("t", "df", D.t_two_sided(F.col("t"), F.col("df")).alias("p"), D.t_upper(F.col("t"), F.col("df")).alias("u"), D.normal_two_sided(F.col("t")).alias("z")).collect():
        assert r.p == pytest.approx(tails.t_two_sided(r.t, r.df), rel=1e-10, abs=1e-280)
        assert r.u == pytest.approx(tails.t_upper(r.t, r.df), rel=1e-10, abs=1e-280)
        assert r.z == pytest.approx(tails.normal_two_sided(r.t), rel=1e-10, abs=1e-280)
    cs = [(float(x), float(df)) for x in (1e-8, 0.1, 0.5, 3.84, 9.0, 20.0, 120.0, 400.0, 1802.0) for df in (0.5, 1, 2, 3, 9, 30, 350, 2000, 50000)]
    for r in spark.createDataFrame(cs, "x double, df double").select("x", "df", D.chi2_upper(F.col("x"), F.col("df")).alias("p")).collect():
        assert r.p == pytest.approx(tails.chi2_upper(r.x, r.df), rel=1e-10, abs=1e-280)
    odd = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0), (math.inf, 2.0), (-math.inf, 2.0)], "t double, df double")
    assert [r.p for r in odd.select(D.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()] == [None, None, None, 0.0, 0.0]
    assert [r.p for r in odd.select(D.chi2_upper(F.col("t"), F.col("df")).alias("p")).collect()] == [None, None, None, 0.0, 1.0]


def test_p_values_of_published_tables(spark):
    rows = [(g, k, n) for g, counts in TABLE.items() for k, n in enumerate(counts)]
    assert A.chi2(spark.createDataFrame(rows, "g string, k int, n long"), "g", "k").first().p == pytest.approx(tails.chi2_upper(CHI2, 9), rel=1e-6)
    same = spark.createDataFrame([(1.0, True)] * 3 + [(1.0, False)] * 3, "v double, g boolean")
    r = A.contrast(same, [], "v", F.col("g")).first()
    assert r.d == 0 and r.t is None and r.p is None


def test_cluster_bootstrap_is_the_distributed_one(spark):
    """The same whatever the partitions, and a row a replicate however many clusters there are."""
    df = spark.createDataFrame([(k, float(k % 10), k % 2, k % 60) for k in range(4000)], "k int, v double, g int, c int")
    a, b = (A.cluster_bootstrap(d, "c", "v", F.col("g") == 1, 300) for d in (df.coalesce(1), df.repartition(9)))
    assert a == {k: pytest.approx(v) for k, v in b.items()} and a["low"] < a["difference"] < a["high"]
    many = spark.range(1_000_000).select((F.col("id") % 999_983).alias("c"), (F.xxhash64("id") % 100).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    r = A.cluster_bootstrap(many, "c", "v", F.col("g") == 1, 50)
    assert r["n_clusters"] == 999_983 and abs(r["difference"]) < 1 and r["high"] - r["low"] < 1


def test_bootstrap_means_by_group(spark, monkeypatch):
    """Against the same weights summed by numpy, over partitions and with few groups held at a time."""
    monkeypatch.setattr(A, "BLOCK", 70)
    rng = np.random.default_rng(3)
    rows = [(k, g, float(x)) for k, (g, x) in enumerate(zip(rng.choice(["a", "b", "c", "few"], 900, p=[0.6, 0.2, 0.195, 0.005]), rng.exponential(3, 900), strict=True))] + [(5000 + k, None, float(k)) for k in range(30)] + [(9999, "a", None)]
    df = spark.createDataFrame(rows, "k long, g string, v double").withColumn("h", F.xxhash64(F.col("k"), F.lit(42)))
    keys = {r.k: r.h for r in df.collect()}
    got = {r.g: r for r in A.bootstrap_means(df.repartition(6), ["g"], "v", "k", 300, least=10).collect()}
    monkeypatch.setattr(A, "GROUPS_HELD", 2)
    again = {r.g: r for r in A.bootstrap_means(df.coalesce(1), ["g"], "v", "k", 300, least=10).collect()}
    assert set(got) == set(again) == {"a", "b", "c", None}
    for g, r in got.items():
        mine = [(keys[k], v) for k, h, v in rows if h == g and v is not None]
        w = A.weights_of(np.array([k for k, _ in mine], "i8"), 300)
        means = (np.array([v for _, v in mine]) @ w) / w.sum(0)
        assert r.n == len(mine) and r.mean == pytest.approx(np.mean([v for _, v in mine]))
        assert [r.low, r.high] == pytest.approx(list(np.percentile(means, [2.5, 97.5])))
        assert [again[g].low, again[g].high] == pytest.approx([r.low, r.high])
    whole = A.bootstrap_means(df, [], "v", "k", 100).first()
    assert whole.low < whole.mean < whole.high and "explode" not in A.bootstrap_means(df, ["g"], "v", "k", 100)._jdf.queryExecution().toString()


@pytest.mark.parametrize("cluster", [None, "c"])
def test_ols_with_factors_matches_numpy(spark, cluster):
    rng = np.random.default_rng(7)
    n = 600
    f, g, c = rng.choice([f"l{k:02d}" for k in range(30)], n), rng.integers(2000, 2004, n), rng.integers(0, 40, n)
    x = rng.normal(size=n)
    y = 2 + 3 * x + np.array([int(v[1:]) for v in f]) * 0.1 + (g - 2000) + rng.normal(size=n)
    rows = [(float(a), float(b), str(u), int(v), int(w)) for a, b, u, v, w in zip(y, x, f, g, c, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, "l01", 2000, 1), (1.0, 1.0, None, 2000, 1)], "y double, x double, f string, g int, c int")
    fit = {r["term"]: r for r in A.ols_factors(df.repartition(5), "y", ["x"], ["f", "g"], cluster)}
    fs, gs = sorted(set(f)), sorted(set(g))
    names = ["const", "x", *(f"f[{v}]" for v in fs[1:]), *(f"g[{v}]" for v in gs[1:])]
    m = np.stack([np.ones(n), x, *(f == v for v in fs[1:]), *(g == v for v in gs[1:])], 1).astype("f8")
    inverse = np.linalg.inv(m.T @ m)
    beta = inverse @ m.T @ y
    e = y - m @ beta
    k = len(names)
    if cluster:
        u = np.stack([(m * e[:, None])[c == v].sum(0) for v in np.unique(c)])
        cov = inverse @ u.T @ u @ inverse * (40 / 39 * (n - 1) / (n - k))
    else:
        cov = inverse * (e @ e) / (n - k)
    assert list(fit) == names
    for term, b, v in zip(names, beta, np.diag(cov), strict=True):
        r = fit[term]
        assert r["coef"] == pytest.approx(b, rel=1e-8, abs=1e-9) and r["se"] == pytest.approx(math.sqrt(v), rel=1e-8) and r["t"] == pytest.approx(b / math.sqrt(v), rel=1e-7, abs=1e-7)
        assert r["n"] == n and r["r2"] == pytest.approx(1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))) and r["low"] < r["coef"] < r["high"]
    assert fit["x"]["p"] < 1e-6
    with pytest.raises(ValueError, match="terms"):
        A.WIDEST, kept = 5, A.WIDEST
        try:
            A.ols_factors(df, "y", ["x"], ["f"])
        finally:
            A.WIDEST = kept
