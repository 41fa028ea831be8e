"""Statistics over groups.

Everything that grows with the data is an aggregate or a window over partitioned keys; the driver sees a few rows of
moments, counts or monthly means and finishes the tests in numpy.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as P
from ..functions import tails
from ..sources import files

# ---- moments and the tests on them -------------------------------------------------------------------------------------


def moments(df: DataFrame, by: list[str], value: str, where: Column | None = None) -> DataFrame:
    """n, mean, var (sample), n_zero of value by group; nulls do not count."""
    v = F.col(value).cast("double") if where is None else F.when(where, F.col(value).cast("double"))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.count_if(v == 0).alias("n_zero"))


def contrast(df: DataFrame, by: list[str], value: str, group: Column, where: Column | None = None) -> DataFrame:
    """One scan: moments of both groups (group true: 1), their difference, Welch's t, df and two-sided p, and Cohen's d (0 without spread)."""
    v = F.col(value).cast("double") if where is None else F.when(where, F.col(value).cast("double"))
    one, two = F.when(group, v), F.when(~group, v)
    names = [(one, "1"), (two, "2")]
    m = df.groupBy(*by).agg(*(f(x).alias(f"{n}{k}") for x, k in names for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))))
    return finish_contrast(m)


def finish_contrast(m: DataFrame) -> DataFrame:
    """difference, t, df, p (two-sided) and d from n1, mean1, var1, n2, mean2, var2."""
    a, b = F.expr("try_divide(var1, n1)"), F.expr("try_divide(var2, n2)")
    pooled = F.sqrt(F.expr("try_divide((n1 - 1) * var1 + (n2 - 1) * var2, n1 + n2 - 2)"))
    found = m.withColumns(
        {
            "difference": F.col("mean1") - F.col("mean2"),
            "t": F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(a + b)),
            "df": F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1)),
            "d": F.when(pooled == 0, 0.0).otherwise(F.try_divide(F.col("mean1") - F.col("mean2"), pooled)),
        }
    )
    return found.withColumn("p", P.t_two_sided(F.col("t"), F.col("df")))


def tost(n1, m1, v1, n2, m2, v2, bound_sd: float = 0.2, welch: bool = False) -> dict:
    """Two one-sided tests for equivalence within bound_sd pooled deviations; pooled or Welch's standard error."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    bound = bound_sd * math.sqrt(pooled)
    a, b = v1 / n1, v2 / n2
    se = math.sqrt(a + b) if welch else math.sqrt(pooled * (1 / n1 + 1 / n2))
    df = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) if welch else n1 + n2 - 2
    diff = m1 - m2
    low, high = tails.t_upper((diff + bound) / se, df), tails.t_upper(-(diff - bound) / se, df)
    return {"difference": diff, "bound": bound, "p": max(low, high), "equivalent": max(low, high) < 0.05}


def benjamini_hochberg(df: DataFrame, p: str, out: str = "p_bh", by: list[str] | None = None) -> DataFrame:
    """Adjusted p-values within families; null p-values stay null and do not count.

    The rank of a value is the number of values up to it, ties included; the minimum runs from the largest value down.  Both
    windows grow row by row.
    """
    family = Window.partitionBy(*(by or []), F.col(p).isNull())
    ranked = df.withColumn("_rank", F.count("*").over(family.orderBy(p))).withColumn("_m", F.count("*").over(family))
    least = F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(family.orderBy(F.col(p).desc()))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_rank", "_m")


# ---- ranks -------------------------------------------------------------------------------------------------------------


def value_ranks(df: DataFrame, value: str, group: Column, by: list[str] | None = None) -> DataFrame:
    """Distinct values with n1, n2 and mid-rank.  Ranks are over distinct values, so ties cost nothing; values are dealt into
    ranges by approximate quantiles, ranked inside a range, and shifted by the totals of the ranges below."""
    keys = by or []
    counts = df.where(F.col(value).isNotNull() & group.isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count_if(group).alias("n1"), F.count_if(~group).alias("n2"))
    edges = sorted(set(df.where(F.col(value).isNotNull()).agg(F.percentile_approx(F.col(value).cast("double"), [k / 64 for k in range(1, 64)], 1000).alias("q")).first()["q"] or []))
    bins = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("value"))) if edges else F.lit(0)
    dealt = counts.withColumn("_bin", bins).withColumn("_n", F.col("n1") + F.col("n2"))
    below = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_s")).withColumn("_below", F.coalesce(F.sum("_s").over(below), F.lit(0))).drop("_s")  # 64 rows a key
    shift = shift.select("_below", F.col("_bin").alias("_b"), *(F.col(k).alias(f"_s{j}") for j, k in enumerate(keys)))
    same = F.col("_bin") == F.col("_b")
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_s{j}"))
    inner = Window.partitionBy(*keys, "_bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_upto", F.sum("_n").over(inner)).join(shift, same).drop("_b", *(f"_s{j}" for j in range(len(keys))))
    return ranked.withColumn("rank", F.col("_below") + F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).drop("_bin", "_n", "_upto", "_below")


def rank_test(df: DataFrame, value: str, group: Column, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney U of group true, z (ties corrected, continuity) and its two-sided p, Cliff's delta and the area under the ROC curve."""
    r = value_ranks(df, value, group, by)
    t = F.col("n1") + F.col("n2")
    s = r.groupBy(*(by or [])).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n, m = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n * (n + 1) / 2
    sd = F.sqrt(n * m / 12 * (n + m + 1 - F.try_divide(F.col("ties"), (n + m) * (n + m - 1))))
    return s.withColumns({"u": u, "z": F.try_divide(F.greatest(F.abs(u - n * m / 2) - 0.5, F.lit(0.0)) * F.signum(u - n * m / 2), sd), "delta": F.try_divide(2 * u, n * m) - 1, "auc": F.try_divide(u, n * m)}).withColumn("p", P.normal_two_sided(F.col("z"))).drop("r1", "ties")


def average_rank(df: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    """df with the mid-rank of value within keys by (null without a value): ranks of distinct values, joined back."""
    ranks = value_ranks(df.where(F.col(value).isNotNull()), value, F.lit(True), by).select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(by)), F.col("value").alias("_v"), F.col("rank").alias(out))
    same = F.col(value) == F.col("_v")
    for j, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    return df.join(ranks, same, "left").drop("_v", *(f"_k{j}" for j in range(len(by))))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks, within keys by."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_rank(average_rank(both, x, "_x", by), y, "_y", by)
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def pearson(df: DataFrame, x: str, y: str, by: list[str], least: int = 11) -> DataFrame:
    """r of complete pairs and its two-sided p, of groups of at least so many pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.corr(x, y).alias("r"), F.count("*").alias("n")).where(F.col("n") >= least)
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300))))
    return both.withColumn("p", P.t_two_sided(t, F.col("n") - 2))


# ---- contingency tables -------------------------------------------------------------------------------------------------


def chi2(table: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    """Statistic, degrees of freedom, p and Cramer's V of a long table of counts (absent cells are 0; empty rows do not count)."""
    cells = table.where(F.col(row).isNotNull() & F.col(col).isNotNull() & (F.col(n) > 0))
    rows, cols = cells.groupBy(row).agg(F.sum(n).alias("_r")), cells.groupBy(col).agg(F.sum(n).alias("_c"))
    total = cells.agg(F.sum(n).alias("_t"))
    # Sum of (n - e)^2 / e over all cells equals t * (sum of n^2 / (r c) - 1), absent cells included.
    s = cells.join(rows, row).join(cols, col).agg(F.sum(F.col(n) * F.col(n) / (F.col("_r") * F.col("_c"))).alias("_s"), F.count_distinct(row).alias("_nr"), F.count_distinct(col).alias("_nc")).crossJoin(total)
    stat = F.col("_t") * (F.col("_s") - 1)
    dof = (F.col("_nr") - 1) * (F.col("_nc") - 1)
    return s.select(stat.alias("chi2"), dof.alias("dof"), P.chi2_upper(stat, dof).alias("p"), F.sqrt(F.try_divide(stat, F.col("_t") * (F.least("_nr", "_nc") - 1))).alias("cramers_v"), F.col("_t").alias("n"))


def two_by_two(df: DataFrame, a: Column, b: Column, by: list[str]) -> DataFrame:
    """Counts n11, n10, n01, n00 with Yates's chi-square and its p, phi and the risk ratio of a by b."""
    c = df.groupBy(*by).agg(*(F.count_if((a == F.lit(bool(i))) & (b == F.lit(bool(j)))).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)))
    n = F.expr("cast(n11 + n10 + n01 + n00 as double)")
    cross = F.greatest(F.abs(F.expr("cast(n11 as double) * n00 - cast(n10 as double) * n01")) - n / 2, F.lit(0.0))
    stat = F.try_divide(n * cross * cross, F.expr("cast(n11 + n10 as double) * (n01 + n00) * (n11 + n01) * (n10 + n00)"))
    return c.withColumns({"chi2": stat, "p": P.chi2_upper(stat, F.lit(1.0)), "phi": F.sqrt(stat / n), "risk_ratio": F.expr("try_divide(try_divide(n11, n11 + n01), try_divide(n10, n10 + n00))")})


def kappa(df: DataFrame, a: str, b: str, labels: list | None = None, by: list[str] | None = None) -> DataFrame:
    """Agreement and Cohen's kappa; with labels, pairs outside them are dropped."""
    keys = by or []
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if labels is not None:
        pairs = pairs.where(F.col(a).isin(labels) & F.col(b).isin(labels))
    counts = pairs.groupBy(*keys, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    by_label = counts.select(*keys, F.explode(F.array(F.struct(F.col("x").alias("l"), F.col("c").alias("p"), F.lit(0).cast("long").alias("q"), F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0).alias("same")), F.struct(F.col("y").alias("l"), F.lit(0).cast("long").alias("p"), F.col("c").alias("q"), F.lit(0).cast("long").alias("same")))).alias("s")).groupBy(*keys, "s.l").agg(F.sum("s.p").alias("p"), F.sum("s.q").alias("q"), F.sum("s.same").alias("same"))
    sums = by_label.groupBy(*keys).agg(F.sum("p").alias("n"), F.sum("same").alias("agree"), F.sum(F.col("p").cast("double") * F.col("q")).alias("chance"))
    po, pe = F.col("agree") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return sums.select(*keys, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)).alias("kappa"))


# ---- resampling ----------------------------------------------------------------------------------------------------------


POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def weights_of(keys: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) weights by row (a hash of its key) and replicate: the same wherever the row is."""
    with np.errstate(over="ignore"):
        x = keys.view("u8")[:, None] + np.arange(1, reps + 1, dtype="u8")[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right").astype("f8")


GROUPS_HELD, BLOCK = 64, 250  #: groups that a task sums at a time; replicates in a packed array


def bootstrap_means(df: DataFrame, by: list[str], value: str, key: str, reps: int = 5000, seed: int = 42, least: int = 1) -> DataFrame:
    """by, n, mean, low, high: percentile intervals of the mean, of groups of at least so many values.

    Rows get Poisson(1) weights by a hash of their key, so the result does not depend on partitions.  A task sums weights and
    weighted values of all replicates in two arrays a group, and hands them on as packed blocks when it holds GROUPS_HELD groups or ends; blocks
    of a group are then added element by element, in streams sorted by group, one block in memory.
    """
    import pyarrow as pa

    names = [f"_k{j}" for j in range(len(by))]
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, by, strict=True))
    kinds = kinds + ", " if kinds else ""
    cuts = [(k, min(k + BLOCK, reps)) for k in range(0, reps, BLOCK)]

    def run(batches):
        held: dict = {}

        def packed():
            rows = [(r, k, w[a:b], s[a:b]) for r, w, s in held.values() for k, (a, b) in enumerate(cuts)]
            held.clear()
            groups = pa.concat_tables([r for r, *_ in rows]).combine_chunks()
            arrays = [pa.array([x[j] for x in rows], pa.list_(pa.float64())) for j in (2, 3)]
            columns = [groups.column(n).combine_chunks() for n in names] if names else []
            return pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns), pa.array([x[1] for x in rows], pa.int32()), *arrays], [*names, "block", "w", "s"])

        for b in batches:
            keys, v = b.column("key").to_numpy(), b.column("value").to_numpy()
            groups = list(zip(*(b.column(n).to_pylist() for n in names), strict=True)) if names else [()] * len(v)
            places: dict = {}
            for i, g in enumerate(groups):
                places.setdefault(g, []).append(i)
            for g, at in places.items():
                if g not in held:
                    if len(held) >= GROUPS_HELD:
                        yield packed()
                    held[g] = pa.Table.from_batches([b.slice(at[0], 1)]), np.zeros(reps), np.zeros(reps)
                _, w_sum, s_sum = held[g]
                for j in range(0, len(at), 256):
                    part = at[j : j + 256]
                    w = weights_of(keys[part], reps)
                    w_sum += w.sum(0)
                    s_sum += v[part] @ w
        if held:
            yield packed()

    def added(batches):
        last, w, s = None, None, None

        def row():
            return pa.RecordBatch.from_arrays([*(last.column(n) for n in [*names, "block"]), pa.array([w], pa.list_(pa.float64())), pa.array([s], pa.list_(pa.float64()))], [*names, "block", "w", "s"])

        for b in batches:
            ids = list(zip(*(b.column(n).to_pylist() for n in [*names, "block"]), strict=True))
            for i, g in enumerate(ids):
                w_i, s_i = (b.column(c)[i].values.to_numpy() for c in "ws")
                if last is not None and g == own:
                    w, s = w + w_i, s + s_i
                    continue
                if last is not None:
                    yield row()
                last, own, w, s = b.slice(i, 1), g, w_i, s_i
        if last is not None:
            yield row()

    columns = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    given = df.where(F.col(value).isNotNull()).select(*columns, F.xxhash64(F.col(key), F.lit(seed)).alias("key"), F.col(value).cast("double").alias("value"))
    sizes = given.groupBy(*names).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).where(F.col("n") >= least)
    schema = f"{kinds}block int, w array<double>, s array<double>"
    parts = given.mapInArrow(run, schema)
    sums = parts.repartition(*names, "block").sortWithinPartitions(*names, "block").mapInArrow(added, schema)
    means = F.filter(F.zip_with("s", "w", lambda a, b: F.try_divide(a, b)), lambda x: x.isNotNull())
    drawn = sums.groupBy(*names).agg(F.array_sort(F.flatten(F.collect_list(means))).alias("m"))  # reps numbers a group

    def cut(share: float) -> Column:
        at = F.lit(share) * (F.size("m") - 1)
        low, high = F.get("m", F.floor(at).cast("int")), F.get("m", F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    for n in names:
        drawn = drawn.withColumnRenamed(n, f"{n}_d")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_d"))
    both = sizes.join(drawn, same) if names else sizes.crossJoin(drawn)  # single rows
    return both.select(*(F.col(n).alias(c) for c, n in zip(by, names, strict=True)), "n", "mean", cut(0.025).alias("low"), cut(0.975).alias("high"))


def bootstrap_contrast(df: DataFrame, value: str, group: Column, key: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """statistic, estimate, low, high: percentile intervals of both means, their difference and Cohen's d.

    Rows get Poisson(1) weights by a hash of their key; every task sums weighted moments for all replicates at once and
    hands on two rows a replicate, whatever its input.
    """

    def run(batches):
        sums = np.zeros((2, reps, 3))
        for b in batches:
            keys, first, v = (b.column(k).to_numpy(zero_copy_only=False) for k in ("key", "first", "value"))
            for j in range(0, len(v), 1024):
                w, x, g = weights_of(keys[j : j + 1024], reps), v[j : j + 1024], first[j : j + 1024].astype(bool)
                for side in (0, 1):
                    at = g == (side == 0)
                    sums[side] += w[at].T @ np.stack([np.ones(at.sum()), x[at], x[at] ** 2], 1)
        import pyarrow as pa

        columns = [np.repeat([1, 2], reps), np.tile(np.arange(reps), 2), *sums.reshape(-1, 3).T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["side", "rep", "w", "s", "q"])

    rows = df.where(F.col(value).isNotNull() & group.isNotNull()).select(F.xxhash64(F.col(key), F.lit(seed)).alias("key"), group.cast("int").alias("first"), F.col(value).cast("double").alias("value"))
    parts = rows.mapInArrow(run, "side long, rep long, w double, s double, q double").groupBy("rep")
    m = parts.agg(*(F.sum(F.when(F.col("side") == k, F.col(c))).alias(f"{n}{k}") for k in (1, 2) for n, c in (("n", "w"), ("s", "s"), ("q", "q"))))
    moments = m.select(*(e for k in "12" for e in (F.col(f"n{k}"), F.expr(f"try_divide(s{k}, n{k})").alias(f"mean{k}"), F.expr(f"try_divide(q{k} - try_divide(s{k} * s{k}, n{k}), n{k} - 1)").alias(f"var{k}"))))
    names = {"mean1": "mean_1", "mean2": "mean_2", "difference": "difference", "d": "d"}
    q = finish_contrast(moments).agg(*(F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(f"q_{c}") for c in names))
    both = q.crossJoin(contrast(df, [], value, group))  # two single rows
    return both.select(F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(c).alias("estimate"), F.col(f"q_{c}")[0].alias("low"), F.col(f"q_{c}")[1].alias("high")) for c, n in names.items()))).alias("r")).select("r.*")


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, group: Column, reps: int = 2000, seed: int = 42) -> dict:
    """Difference of group means over resampled clusters: estimate, 95 % interval, p (at least 1 / reps), n_clusters.

    Clusters get Poisson(1) weights by their hash; every task sums weighted counts and sums for all replicates, so a row a
    replicate reaches the driver however many clusters there are.
    """

    def run(batches):
        sums = np.zeros((reps, 4))
        for b in batches:
            a = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in ("n1", "s1", "n2", "s2")], 1).astype("f8")
            keys = b.column("key").to_numpy()
            for j in range(0, len(a), 1024):
                sums += weights_of(keys[j : j + 1024], reps).T @ a[j : j + 1024]
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), *(pa.array(c) for c in sums.T)], ["rep", "n1", "s1", "n2", "s2"])

    v, zero = F.col(value).cast("double"), F.lit(0.0)
    parts = [f(F.when(g, v)) for g in (group, ~group) for f in (F.count, F.sum)]
    each = df.groupBy(F.col(cluster).alias("_c")).agg(*(F.coalesce(p.cast("double"), zero).alias(n) for p, n in zip(parts, ("n1", "s1", "n2", "s2"), strict=True)))
    each = each.select(F.xxhash64("_c", F.lit(seed)).alias("key"), "n1", "s1", "n2", "s2")
    total = each.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("n1", "s1", "n2", "s2"))).first()
    drawn = each.mapInArrow(run, "rep long, n1 double, s1 double, n2 double, s2 double").groupBy("rep").agg(*(F.sum(c).alias(c) for c in ("n1", "s1", "n2", "s2"))).where("n1 > 0 and n2 > 0")
    diff = np.array([r.d for r in drawn.select(F.expr("s1 / n1 - s2 / n2").alias("d")).collect()])  # a row a replicate
    p = max(1 / reps, min(1.0, 2 * min((diff <= 0).mean(), (diff >= 0).mean())))
    low, high = np.percentile(diff, [2.5, 97.5])
    return {"difference": total.s1 / total.n1 - total.s2 / total.n2, "low": float(low), "high": float(high), "p": float(p), "n_clusters": total.n}


def kappa_of(table: np.ndarray) -> np.ndarray:
    """Cohen's kappa of tables (..., a, b) of counts; nan where chance alone explains all."""
    n = table.sum((-2, -1))
    with np.errstate(all="ignore"):
        agree = np.trace(table, axis1=-2, axis2=-1) / n
        chance = (table.sum(-1) * table.sum(-2)).sum(-1) / n**2
        return np.where(chance < 1, (agree - chance) / (1 - chance), np.nan)


def kappa_ci(df: DataFrame, a: str, b: str, labels: list, reps: int = 2000, seed: int = 42) -> dict:
    """n, kappa and its bootstrap interval over pairs of the given labels: resampled pairs are a multinomial draw of the table
    of counts, so only that table (labels by labels) reaches the driver."""
    counts = df.where(F.col(a).isin(labels) & F.col(b).isin(labels)).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n")).collect()
    table = np.zeros((len(labels), len(labels)), "i8")
    for r in counts:
        table[labels.index(r.x), labels.index(r.y)] = r.n
    n = int(table.sum())
    if n < 5:  # fixed value: below, there is no interval
        return {"n": n, "kappa": float(kappa_of(table.astype("f8"))) if n else math.nan, "low": math.nan, "high": math.nan}
    drawn = kappa_of(np.random.default_rng(seed).multinomial(n, table.ravel() / n, reps).reshape(-1, *table.shape).astype("f8"))
    drawn = drawn[~np.isnan(drawn)]
    low, high = np.percentile(drawn, [2.5, 97.5]) if len(drawn) else (math.nan, math.nan)
    return {"n": n, "kappa": float(kappa_of(table.astype("f8"))), "low": float(low), "high": float(high)}


def proportion_ci(k: int, n: int, reps: int = 2000, seed: int = 42) -> tuple[float, float]:
    """Bootstrap interval of a proportion by order statistics: a resample of 0/1 values is a binomial draw; none for n < 2."""
    if n < 2:
        return math.nan, math.nan
    drawn = np.sort(np.random.default_rng(seed).binomial(n, k / n, reps) / n)
    return float(drawn[round(0.025 * (reps - 1))]), float(drawn[round(0.975 * (reps - 1))])


def agreement(pairs: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of coder pairs with <field>_a and <field>_b: agreement by coder pair and field (n, n_equal, share), and the rows that
    differ (packet, coders, field, both values).  Pairs with a blank label do not count."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.trim(f"{f}_a").alias("value_a"), F.trim(f"{f}_b").alias("value_b")) for f in fields))
    long = pairs.select("packet", "coder_a", "coder_b", F.explode(each).alias("x")).select("packet", "coder_a", "coder_b", "x.*").where("value_a <> '' and value_b <> ''")
    table = long.groupBy("coder_a", "coder_b", "field").agg(F.count("*").alias("n"), F.count_if(F.col("value_a") == F.col("value_b")).alias("n_equal")).withColumn("share", F.col("n_equal") / F.col("n"))
    return table, long.where("value_a <> value_b")


# ---- linear models and time series ---------------------------------------------------------------------------------------


def normal_equations(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n of a linear model, in one aggregate."""
    cols = [*xs, y]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(F.count("*").alias("n"), *(F.sum(F.col(cols[i]).cast("double") * F.col(cols[j])).alias(f"s{i}_{j}") for i, j in pairs)).first()
    full = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        full[i, j] = full[j, i] = row[f"s{i}_{j}"] or 0.0
    return full[:-1, :-1], full[:-1, -1], float(full[-1, -1]), int(row["n"])


def ols_clustered(df: DataFrame, y: str, xs: list[str], cluster: str) -> list[dict]:
    """Least squares with cluster-robust errors (G / (G - 1) * (n - 1) / (n - k)) and normal p-values."""
    xtx, xty, _, n = normal_equations(df, y, xs)
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ xty
    e = F.col(y).cast("double") - sum((F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
    scored = df.withColumn("_e", e).groupBy(cluster).agg(*(F.sum(F.col(x) * F.col("_e")).alias(f"u{i}") for i, x in enumerate(xs)))
    outer = scored.agg(F.count("*").alias("g"), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(len(xs)) for j in range(len(xs)))).first()
    g, k = outer["g"], len(xs)
    meat = np.array([[outer[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    cov = inverse @ meat @ inverse * (g / (g - 1) * (n - 1) / (n - k))
    out = []
    for x, b, v in zip(xs, beta, np.diag(cov), strict=True):
        se = math.sqrt(max(v, 0))
        out.append({"term": x, "coef": float(b), "se": se, "p": tails.normal_two_sided(float(b) / se) if se else math.nan, "low": float(b - 1.959963984540054 * se), "high": float(b + 1.959963984540054 * se)})
    return out


WIDEST = 3000  #: terms of a linear model that the driver solves


def ols_factors(df: DataFrame, y: str, xs: list[str], factors: list[str], cluster: str | None = None) -> list[dict]:
    """Least squares of y on a constant, numeric columns and factors, whose first level by sort order is left out.

    Rows: term (`const`, a column, or `factor[level]`), coef, se, t, p, low, high, n, r2.  Errors are classical (t distribution), or robust to clusters
    (normal, G / (G - 1) * (n - 1) / (n - k)).  Rows with a null anywhere do not count.

    Moments are summed by combination of levels, so a row adds to (numbers + 2)^2 / 2 sums however many levels there are.  They become cells
    (row, column, sum) of the normal equations in long form, at most WIDEST squared, which the driver solves.  A second scan
    sums residuals by cluster and combination; a cluster's scores are a sparse vector, and tasks add their outer products to one matrix each.
    """
    import pyarrow as pa

    used = [y, *xs, *factors, *([cluster] if cluster else [])]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in used))
    level = [F.col(f).cast("string").alias(f"_f{j}") for j, f in enumerate(factors)]
    keys = [f"_f{j}" for j in range(len(factors))]
    value = [F.lit(1.0), *(F.col(x).cast("double") for x in xs), F.col(y).cast("double")]
    pairs = [(i, j) for i in range(len(value)) for j in range(i, len(value))]
    moments = files.spooled(rows.groupBy(*level).agg(*(F.sum(value[i] * value[j]).alias(f"s{i}_{j}") for i, j in pairs)), "moments")
    levels = {f: [r[0] for r in moments.select(k).distinct().orderBy(k).limit(WIDEST + 1).collect()] for f, k in zip(factors, keys, strict=True)}
    terms = ["const", *xs, *(f"{f}[{v}]" for f in factors for v in levels[f][1:])]
    if len(terms) > WIDEST:
        raise ValueError(f"more than {WIDEST} terms")
    place = {f: {v: 1 + len(xs) + sum(len(levels[g]) - 1 for g in factors[:i]) + k for k, v in enumerate(levels[f][1:])} for i, f in enumerate(factors)}

    def number(f: str, k: str) -> Column:
        """The term of a level; null for the one left out."""
        known = place[f]
        return F.element_at(F.create_map(*(F.lit(x) for v, n in known.items() for x in (v, n))), F.col(k)) if known else F.lit(None).cast("int")

    placed = moments.select(*(number(f, k).alias(k) for f, k in zip(factors, keys, strict=True)), *(f"s{i}_{j}" for i, j in pairs))
    last = len(xs) + 1  # y
    cells = [(F.lit(i), F.lit(-1 if j == last else j), F.col(f"s{i}_{j}")) for i, j in pairs if i < last]
    cells += [(F.col(k), F.lit(-1 if j == last else j), F.col(f"s0_{j}")) for k in keys for j in range(last + 1)]
    both = [(a, b, F.col(a).isNotNull() & F.col(b).isNotNull()) for i, a in enumerate(keys) for b in keys[i:]]
    cells += [(F.when(held, F.col(a)), F.when(held, F.col(b)), F.col("s0_0")) for a, b, held in both]
    long = placed.select(F.explode(F.array(*(F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), s.alias("s")) for r, c, s in cells))).alias("x")).select("x.*").where("r is not null and c is not null")
    width, total = len(terms), placed.agg(F.sum("s0_0"), F.sum(f"s0_{last}"), F.sum(f"s{last}_{last}")).first()
    xtx, xty = np.zeros((width, width)), np.zeros(width)
    for r in long.groupBy("r", "c").agg(F.sum("s").alias("s")).toLocalIterator():  # cells
        if r.c < 0:
            xty[r.r] = r.s
        else:
            xtx[r.r, r.c] = xtx[r.c, r.r] = r.s
    n = int(total[0] or 0)
    inverse = np.linalg.pinv(xtx, hermitian=True)
    beta = inverse @ xty
    fit = sum((F.col(x).cast("double") * float(b) for x, b in zip(xs, beta[1:], strict=False)), F.lit(float(beta[0])))
    for f in factors:
        effects = {v: float(beta[k]) for v, k in place[f].items()}
        if effects:
            fit = fit + F.coalesce(F.element_at(F.create_map(*(F.lit(x) for v, e in effects.items() for x in (v, e))), F.col(f).cast("string")), F.lit(0.0))
    e, mean = F.col("_e"), (total[1] or 0.0) / max(n, 1)
    left = rows.withColumn("_e", F.col(y).cast("double") - fit)
    squares = left.agg(F.sum(e * e), F.sum((F.col(y).cast("double") - mean) * (F.col(y).cast("double") - mean))).first()
    r2 = 1 - squares[0] / squares[1] if squares[1] else math.nan
    if cluster is None:
        cov = inverse * (squares[0] / (n - width)) if n > width else np.full((width, width), math.nan)
    else:
        sums = left.groupBy(F.col(cluster).alias("_g"), *level).agg(*(F.sum(e * v).alias(f"u{j}") for j, v in enumerate(value[:-1])))
        each = [(F.lit(j), F.col(f"u{j}")) for j in range(last)] + [(number(f, k), F.col("u0")) for f, k in zip(factors, keys, strict=True)]
        scores = sums.select("_g", F.explode(F.array(*(F.struct(r.cast("int").alias("r"), u.alias("u")) for r, u in each))).alias("x")).select("_g", "x.*").where("r is not null").groupBy("_g", "r").agg(F.sum("u").alias("u"))
        vectors = scores.groupBy("_g").agg(F.collect_list(F.struct("r", "u")).alias("v"))  # at most a number a term

        def outer(batches):
            meat, count = np.zeros((width, width)), 0
            for b in batches:
                for v in b.column("v"):
                    at, u = (np.array(v.values.field(c)) for c in ("r", "u"))
                    meat[np.ix_(at, at)] += np.outer(u, u)
                    count += 1
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(width)], pa.int32()), pa.array([[float(count)], *meat], pa.list_(pa.float64()))], ["r", "m"])

        parts = vectors.select("v").mapInArrow(outer, "r int, m array<double>").select("r", F.posexplode("m").alias("c", "m")).groupBy("r", "c").agg(F.sum("m").alias("m"))
        meat, g = np.zeros((width, width)), 0
        for r in parts.toLocalIterator():  # cells
            if r.r < 0:
                g = r.m
            else:
                meat[r.r, r.c] = r.m
        cov = inverse @ meat @ inverse * (g / (g - 1) * (n - 1) / (n - width)) if g > 1 and n > width else np.full((width, width), math.nan)
    out, reach = [], 1.959963984540054 if cluster else (tails.t_quantile(0.975, n - width) if n > width else math.nan)
    for term, b, v in zip(terms, beta.tolist(), np.diag(cov).tolist(), strict=True):
        se = math.sqrt(v) if v > 0 else math.nan
        t = b / se
        p = math.nan if math.isnan(t) else tails.normal_two_sided(t) if cluster else tails.t_two_sided(t, n - width)
        out.append({"term": term, "coef": b, "se": se, "t": t, "p": p, "low": b - reach * se, "high": b + reach * se, "n": n, "r2": r2})
    return out


def monthly(df: DataFrame, date: str, value: str, by: list[str] | None = None) -> DataFrame:
    """month, mean, n by calendar month."""
    return df.where(F.col(value).isNotNull() & F.col(date).isNotNull()).groupBy(*(by or []), F.to_date(F.date_trunc("month", F.col(date))).alias("month")).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count("*").alias("n"))


def month_gaps(series: DataFrame) -> DataFrame:
    """Months between the first and last of a series that it lacks."""
    span = series.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
    return span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month")).join(series.select("month"), "month", "left_anti")


def its_design(series: DataFrame, at: str) -> DataFrame:
    """time (months since the first), post (from the month of at on), time_after (months since that month)."""
    first = series.agg(F.min("month").alias("_first"))
    ordinal = lambda c: F.year(c) * 12 + F.month(c) - 1
    then = F.lit(int(at[:4]) * 12 + int(at[5:7]) - 1)
    s = series.crossJoin(F.broadcast(first))  # one row
    return s.select("month", "mean", "n", (ordinal(F.col("month")) - ordinal(F.col("_first"))).cast("long").alias("time"), (ordinal(F.col("month")) >= then).cast("long").alias("post"), F.greatest(ordinal(F.col("month")) - then, F.lit(0)).cast("long").alias("time_after"))


def segmented(design: list, lag: int | None = 3, least: int = 6) -> dict:
    """Weighted least squares with Newey-West errors on a monthly design (at most some hundred rows)."""
    rows = sorted(design, key=lambda r: r.month)
    pre, post = sum(r.post == 0 for r in rows), sum(r.post == 1 for r in rows)
    if pre < least or post < least:
        return {"status": "too few months", "n_pre": pre, "n_post": post}
    x = np.array([[1, r.time, r.post, r.time_after] for r in rows], "f8")
    y, w = np.array([r.mean for r in rows]), np.array([r.n for r in rows], "f8")
    xw, yw = x * np.sqrt(w)[:, None], y * np.sqrt(w)
    inverse = np.linalg.pinv(xw.T @ xw)
    beta = inverse @ xw.T @ yw
    e = yw - xw @ beta
    n = len(y)
    lag = int(4 * (n / 100) ** (2 / 9)) if lag is None else lag
    u = xw * e[:, None]
    meat = u.T @ u
    for k in range(1, lag + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (lag + 1)) * (g + g.T)
    cov = inverse @ meat @ inverse
    h = min(12, post - 1)
    resid = y - x @ beta
    out = {"status": "ok", "n_pre": pre, "n_post": post, "lag": lag, "durbin_watson": durbin_watson(resid)}
    return out | inference(beta, cov, n - 4, h)


def durbin_watson(e: np.ndarray) -> float:
    return float((np.diff(e) ** 2).sum() / (e**2).sum()) if (e**2).sum() else math.nan


def inference(beta: np.ndarray, cov: np.ndarray, df: int, horizon: int) -> dict:
    """Estimate, standard error, p and 95 % interval of every coefficient, and of the effect at the horizon."""
    out, q = {"horizon": horizon}, tails.t_quantile(0.975, df)
    for name, at in (("const", [1, 0, 0, 0]), ("time", [0, 1, 0, 0]), ("post", [0, 0, 1, 0]), ("time_after", [0, 0, 0, 1]), ("at_horizon", [0, 0, 1, horizon])):
        c = np.array(at, "f8")
        b, se = float(c @ beta), math.sqrt(max(c @ cov @ c, 0))
        out |= {"effect_at_horizon" if name == "at_horizon" else name: b, f"se_{name}": se, f"p_{name}": float(tails.t_two_sided(b / se, df)) if se else math.nan, f"low_{name}": b - q * se, f"high_{name}": b + q * se}
    return out


def glsar(design: list, most: int = 50, tolerance: float = 1e-4, least: int = 6) -> dict:
    """The unweighted model with AR(1) errors: rho by Yule-Walker (adjusted for lost pairs) from the residuals, until no
    coefficient moves by more than the tolerance; inference on the whitened model."""
    rows = sorted(design, key=lambda r: r.month)
    pre, post = sum(r.post == 0 for r in rows), sum(r.post == 1 for r in rows)
    if pre < least or post < least:
        return {"status": "too few months", "n_pre": pre, "n_post": post}
    x, y = np.array([[1, r.time, r.post, r.time_after] for r in rows], "f8"), np.array([r.mean for r in rows], "f8")
    n, rho, last, turn = len(y), 0.0, None, 0

    def fitted():
        xs, ys = x[1:] - rho * x[:-1], y[1:] - rho * y[:-1]
        return xs, ys, np.linalg.lstsq(xs, ys, rcond=None)[0]

    for turn in range(1, most):
        beta = fitted()[2]
        if last is not None and np.max(np.abs(last - beta) / np.abs(last)) < tolerance:
            break
        last = beta
        e = y - x @ beta
        e = e - e.mean()
        spread = (e @ e) / n
        rho = float((e[:-1] @ e[1:]) / (n - 1) / spread) if spread else 0.0
    xs, ys, beta = fitted()
    e = ys - xs @ beta
    cov = np.linalg.pinv(xs.T @ xs) * (e @ e) / (n - 1 - 4)
    return {"status": "ok", "n_pre": pre, "n_post": post, "rho": rho, "iterations": turn, "durbin_watson": durbin_watson(e)} | inference(beta, cov, n - 1 - 4, min(12, post - 1))
