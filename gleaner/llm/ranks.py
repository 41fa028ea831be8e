"""Positions of rows in an order, without a window over all rows of a key.

Rows are dealt into ranges of the order and written once; each range is numbered on its own, and counts of the ranges below
shift it.  So a key may hold any share of the rows.  The keys must not be null; null order columns come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BELOW = (Window.unboundedPreceding, -1)


def dealt(df: DataFrame, order: list[str], name: str, leave: tuple = ()) -> DataFrame:
    """df in ranges of the order, spooled: _part is the range, _at grows along the order; columns to leave are sorted by, not kept.

    df is spooled before, as ranges are drawn from a sample that would compute it twice; equal rows are split by where they stood.
    """
    first = common.spool(df.withColumn("_seq", F.monotonically_increasing_id()), f"{name}-unsorted")
    ranges = first.repartitionByRange(*order, "_seq").sortWithinPartitions(*order, "_seq")
    out = common.spool(ranges.drop("_seq", *leave).withColumn("_at", F.monotonically_increasing_id()), name)
    common.drop(first)
    part = out.withColumn("_part", F.shiftright("_at", 33))
    part.spooled = out.spooled
    return part


def ranges_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of dealt rows, by range and key: _shift (position in the key less _at), _total (rows of the key)."""
    sizes = rows.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*by)  # a row a range
    below = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(*BELOW)), F.lit(0))
    return sizes.select("_part", *by, (below - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("_total"))


def numbered(rows: DataFrame, by: list[str], pos: str, total: str | None = None) -> DataFrame:
    """Dealt rows with pos, their place (from 0) among the rows of their key, and the number of these."""
    sizes = common.spool(ranges_of(rows, by), "ranges")
    out = rows.join(common.small(sizes), ["_part", *by]).withColumn(pos, F.col("_at") + F.col("_shift"))
    out = out.withColumn(total, F.col("_total")) if total else out
    return out.drop("_part", "_at", "_shift", "_total")
