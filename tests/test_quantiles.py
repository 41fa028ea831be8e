import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import quantiles as Q

SHARES = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]


def brute(rows):
    groups = {}
    for g, v in rows:
        if v is not None and math.isfinite(v):
            groups.setdefault(g, []).append(v)
    return {g: (len(v), np.quantile(v, SHARES)) for g, v in groups.items()}


@pytest.mark.parametrize(("bins", "few"), [(2, 1), (7, 3), (1024, 10_000)])
def test_against_sorting(spark, bins, few):
    """Ties, nulls, numbers that are none, one value, two neighbours, widths beyond a double, a heavy tail, a null group."""
    rng = np.random.default_rng(5)
    rows = [("tied", float(x)) for x in rng.integers(0, 5, 200)] + [("tail", float(x)) for x in np.exp(rng.normal(0, 8, 150))] + [("one", 3.5)] * 4 + [("two", 1.0), ("two", math.nextafter(1.0, 2))]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324)] + [(None, float(k)) for k in range(11)] + [("odd", None), ("odd", math.nan), ("odd", math.inf), ("odd", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r for r in Q.exact(df, ["g"], "v", SHARES, bins, few).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for g, (n, q) in want.items():
        assert got[g].n == n
        if g != "wide":  # the library's own interpolation overflows there
            assert got[g].q == pytest.approx(list(q), rel=1e-12), g
    assert got["wide"].q[0] == -1.7e308 and got["wide"].q[3] == 0.0 and got["wide"].q[-1] == 1.7e308


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(float(k),) for k in range(101)], "v double")
    assert Q.exact(df, [], "v", [0.25, 0.5], 3, 5).first().q == [25.0, 50.0]
    assert Q.exact(df.limit(0), [], "v", [0.5]).count() == 0
    assert Q.exact(df, [], "v", [0.5]).columns == ["n", "q"]
    with pytest.raises(ValueError, match="shares"):
        Q.exact(df, [], "v", [1.5])


def test_five_million_distinct_values(spark):
    """In three groups; known by construction: a permutation of even steps."""
    n = 5_000_000
    df = spark.range(0, n, 1, 8).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % n / 4.0).alias("v"))
    got = {r.g: r for r in Q.exact(df, ["g"], "v", [0.1, 0.5]).collect()}
    values = np.arange(n, dtype="i8")
    for g in range(3):
        mine = (values[g::3] * 7919) % n / 4.0
        assert got[g].n == len(mine) and got[g].q == pytest.approx(list(np.quantile(mine, [0.1, 0.5])), rel=1e-12)
