"""Exact quantiles by group, without holding a group's values anywhere.

Every quantile needs one or two order statistics.  Each of these is looked for in a span of values that is known to hold it: a
pass counts the rows of the span in bins of equal width, with each bin's smallest and largest value, and the bin that holds the rank
becomes the next span.  Counts combine before the shuffle, so a pass moves bins, not rows.  A span of one value is the
answer; spans of few rows are sorted as they are.  Both ends of a span lie in different bins, so every pass leaves fewer distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files

BINS = 1024
FEW = 10_000  #: rows of a span that are sorted
SMALL = 100_000  #: spans that may be broadcast


def all_of(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def within(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the span (lo, hi) of their key that holds their value; spans of a key do not overlap."""
    named = spans.select(*(F.col(k).alias(f"{k}_s") for k in keys), "lo", "hi")
    named = F.broadcast(named) if named.count() <= SMALL else named
    on = all_of(F.col(k).eqNullSafe(F.col(f"{k}_s")) for k in keys) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    return rows.join(named, on).drop(*(f"{k}_s" for k in keys))


def found_in(ranks: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks (keys, k, lo, hi, below) with that part (low, high, size, in order of low) of their span that holds them."""
    order = Window.partitionBy(*keys, "lo", "hi").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    p = parts.withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0))).select(*(F.col(k).alias(f"{k}_p") for k in keys), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "low", "high", "size", "_before")
    same = all_of(F.col(k).eqNullSafe(F.col(f"{k}_p")) for k in keys) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
    at = F.col("k") - F.col("below")
    joined = ranks.drop("size").join(p, same & (F.col("_before") <= at) & (at < F.col("_before") + F.col("size")))
    return joined.select(*keys, "k", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("below") + F.col("_before")).alias("below"), "size")


def order_statistics(rows: DataFrame, keys: list[str], ranks: DataFrame, bins: int, few: int) -> DataFrame:
    """keys, k, value: the k-th smallest (from 0) v of rows, for ranks (keys, k, lo, hi, below, size)."""
    done = []
    while True:
        ranks = files.spooled(ranks, "ranks")
        done.append(ranks.where("lo = hi or size <= " + str(few)))
        wide = ranks.where(f"lo < hi and size > {few}")
        if wide.isEmpty():
            break
        width = F.col("hi") - F.col("lo")
        halves = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        share = F.when(width < float("inf"), (F.col("v") - F.col("lo")) / width).otherwise(halves)  # a width may be beyond a double
        counted = within(rows, files.spooled(wide.select(*keys, "lo", "hi").distinct(), "spans"), keys).groupBy(*keys, "lo", "hi", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin"))
        ranks = found_in(wide, counted.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("size")), keys)
    ranks = done[0]
    for d in done[1:]:
        ranks = ranks.unionByName(d)
    open_ = ranks.where("lo < hi")
    values = within(rows, files.spooled(open_.select(*keys, "lo", "hi").distinct(), "spans"), keys).groupBy(*keys, "lo", "hi", F.col("v").alias("low")).agg(F.first("v").alias("high"), F.count("*").alias("size"))
    last = found_in(open_, values, keys)
    return ranks.where("lo = hi").unionByName(last.select(*ranks.columns)).select(*keys, "k", F.col("lo").alias("value"))


def exact(df: DataFrame, by: list[str], value: str, shares: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """by, n, q: the quantiles of value by group, linear between neighbours.

    Null, NaN and infinite values do not count; a group without others is absent.  df is read once a pass (two or three times as a rule), so
    give it as a table.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares are from 0 to 1")
    keys = [f"_k{j}" for j in range(len(by))] or ["_k"]
    columns = [F.col(c).alias(k) for c, k in zip(by, keys, strict=False)] or [F.lit(0).alias("_k")]
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*columns, v.alias("v"))
    groups = files.spooled(rows.groupBy(*keys).agg(F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    place = [F.lit(s) * (F.col("size") - 1) for s in shares]
    wanted = F.array_distinct(F.array(*(f(p).cast("long") for p in place for f in (F.floor, F.ceil))))
    ranks = groups.select(*keys, F.explode(wanted).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), "size")
    found = order_statistics(rows, keys, ranks, bins, few).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))
    sizes = groups.select(*(F.col(k).alias(f"{k}_g") for k in keys), "size")
    both = found.join(sizes, all_of(F.col(k).eqNullSafe(F.col(f"{k}_g")) for k in keys))
    low, high = ([F.element_at("at", f(p).cast("long")) for p in place] for f in (F.floor, F.ceil))
    q = F.array(*(a + (b - a) * (p - F.floor(p)) for a, b, p in zip(low, high, place, strict=True)))
    return both.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=False)), F.col("size").alias("n"), q.alias("q"))


def joined(df: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """A table by group with its quantiles q beside it; null where a group has no values."""
    q = quantiles.select(*(F.col(c).alias(f"_{c}_q") for c in by), "q")
    return df.join(q, all_of(F.col(c).eqNullSafe(F.col(f"_{c}_q")) for c in by), "left").drop(*(f"_{c}_q" for c in by)) if by else df.crossJoin(F.broadcast(q))  # one row
