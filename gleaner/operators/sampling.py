"""Samples that depend on a seed and the rows' keys alone, not on order or partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(key: str, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def uniform(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (a top-k, so no total sort)."""
    return df.orderBy(draw_order(key, seed), key).limit(n)


def stratified(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum."""
    w = Window.partitionBy(stratum).orderBy(draw_order(key, seed), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_up(df: DataFrame, done: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """Those done, and as many others as each stratum needs to have n.

    The others are drawn apart, at most n a stratum, so that Spark prunes each partition to its first rows before they move;
    the counts of those done are a row a stratum.
    """
    ids = done.select(key).distinct()
    had = df.join(ids, key, "left_semi")
    counts = had.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_had"))
    w = Window.partitionBy(stratum).orderBy(draw_order(key, seed), key)
    fresh = df.join(ids, key, "left_anti").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    wanted = fresh.join(counts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").where(F.col("_rn") + F.coalesce("_had", F.lit(0)) <= n)
    return had.unionByName(wanted.select(*df.columns))


def overlap(df: DataFrame, key: str, coders: list[str], shared: int, own: int, seed: int = 42) -> DataFrame:
    """coder and rows: the same shared rows for all coders, and own others for each, without repeats."""
    both = uniform(df, key, shared, seed)
    rest = df.join(both.select(key), key, "left_anti").orderBy(draw_order(key, seed + 1), key).limit(own * len(coders))
    numbered = rest.withColumn("_rn", F.row_number().over(Window.orderBy(draw_order(key, seed + 1), key)) - 1)  # own * coders rows
    spark = df.sparkSession
    names = spark.createDataFrame([(c, k) for k, c in enumerate(coders)], "coder string, _k int")
    mine = numbered.join(F.broadcast(names), F.floor(F.col("_rn") / own) == F.col("_k")).withColumn("overlap_set", F.lit(False)).drop("_rn", "_k")
    return both.withColumn("coder", F.explode(F.array(*map(F.lit, coders)))).withColumn("overlap_set", F.lit(True)).unionByName(mine)


def buckets(df: DataFrame, key: str, rules: list[tuple[str, Column, int]], seed: int = 42) -> DataFrame:
    """bucket and rows: for each rule in turn up to n rows whose key no earlier bucket took.

    One scan: a bucket's rows are among the first n_1 + ... + n of its rule in draw order, as earlier buckets take at most the others.  Those are a
    top-k by rule, pruned before the shuffle; the choice in turn is made on these few.
    """
    limits, total = [], 0
    for _, _, n in rules:
        total += n
        limits.append(total)
    matched = F.array_compact(F.array(*(F.when(rule, k) for k, (_, rule, _) in enumerate(rules))))
    drawn = df.withColumn("_draw", draw_order(key, seed)).withColumn("_rule", F.explode(matched))
    most = F.element_at(F.array(*map(F.lit, limits)), F.col("_rule") + 1)
    first = drawn.withColumn("_rn", F.row_number().over(Window.partitionBy("_rule").orderBy("_draw", key))).where(F.col("_rn") <= limits[-1]).where(F.col("_rn") <= most)

    def choose(frame):
        took, rows = set(), []
        for k, (_, _, n) in enumerate(rules_n):
            mine = frame[(frame["_rule"] == k) & ~frame[key].isin(took)].sort_values("_rn").head(n)
            took |= set(mine[key])
            rows.append(mine.assign(bucket=names[k]))
        return pd.concat(rows)[[*columns, "bucket"]]

    columns, names, rules_n = df.columns, [r[0] for r in rules], [(r[0], None, r[2]) for r in rules]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return first.groupBy(F.lit(0).alias("_one")).applyInPandas(choose, f"{schema}, bucket string")


def assert_blind(df: DataFrame, hidden: list[str]) -> DataFrame:
    """df, if none of its columns is hidden from coders."""
    leaked = sorted(set(hidden) & set(df.columns))
    if leaked:
        raise ValueError(f"columns that coders must not see: {leaked}")
    return df
