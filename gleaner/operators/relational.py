"""Joins, deduplication, set operations, windows and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..sources import files


def entity_table(spark: SparkSession, config: Config) -> DataFrame:
    """name, region, kind, start, end, ord, variants of the configured entities: as many rows as the configuration has."""
    rows = [(e.name, e.region, e.kind, e.start, e.end, k, list(e.variants)) for k, e in enumerate(config.entities)]
    df = spark.createDataFrame(rows, "name string, region string, kind string, start string, end string, ord int, variants array<string>")
    return df.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})


def first_match(text: Column, patterns) -> Column:
    """Target of the first (pattern, target) whose pattern the text contains."""
    out = None
    for p, target in patterns:
        out = F.when(F.contains(text, F.lit(p)), target) if out is None else out.when(F.contains(text, F.lit(p)), target)
    return out


def interval_lookup(df: DataFrame, dim: DataFrame, keys: list[str], date: str, name: str = "name", start: str = "start", end: str = "end", order: str = "ord", out: str = "found") -> DataFrame:
    """Left join to the first interval (inclusive, null end open) of the same keys that holds the date.

    The dimension is folded to one row a key with its intervals as a sorted array, so the fact side keeps its rows and
    partitioning and the pick happens in the row.
    """
    folded = dim.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, start, end, name))).alias("_intervals"))
    joined = df.join(folded, keys, "left")
    held = F.filter("_intervals", lambda x: (x[start] <= F.col(date)) & (F.col(date) <= F.coalesce(x[end], F.to_date(F.lit("9999-12-31")))))
    return joined.withColumn(out, F.get(held, F.lit(0))[name]).drop("_intervals")


OPEN = "9999-12-31"


def interval_join(df: DataFrame, dim: DataFrame, keys: list[str], date: str, name: str = "name", start: str = "start", end: str = "end", order: str = "ord", out: str = "found") -> DataFrame:
    """interval_lookup() for a dimension of any size: nothing holds all intervals of a key, and no date meets them one by one.

    Of intervals of the same keys, start and end the first (by order, then name) is kept.  Each is cut into whole blocks of
    powers of two days, two of a size at most, and of a block again the first is kept, so there is one row a block.  Each pair
    of keys and date that occurs looks up the one block of every size that holds it, by equality, and the first of what it
    finds is kept.  Intervals that end before they start hold no date.
    """
    none = F.to_date(F.lit(OPEN))
    known = dim.where(" and ".join(f"`{k}` is not null" for k in [*keys, start])).select(*(F.col(k).alias(f"_{k}") for k in keys), F.unix_date(F.col(start).cast("date")).cast("long").alias("_s"), (F.unix_date(F.coalesce(F.col(end).cast("date"), none)) + 1).cast("long").alias("_e"), F.struct(F.col(order).alias("o"), F.col(name).alias("n")).alias("_v")).where("_s < _e")
    own = [f"_{k}" for k in keys]
    longest = known.agg(F.max(F.col("_e") - F.col("_s"))).first()[0] or 0
    sizes = F.lit(list(range(longest.bit_length()))).cast("array<int>")  # blocks of 1, 2, 4, ... days, up to the longest interval

    def blocks(low: Column, high: Column) -> Column:
        """level and block of the parts of low to high (exclusive)."""

        def of(j: Column) -> Column:
            up = F.pow(F.lit(2.0), j)
            first, last = F.ceil(low / up), F.floor(high / up)  # whole blocks; days are small enough for exact quotients
            odd = lambda x: F.pmod(x, F.lit(2)) == 1
            left = F.when((first < last) & odd(first), first)
            right = F.when((first < last) & odd(last), last - 1)
            return F.array(*(F.struct(j.alias("level"), x.cast("long").alias("block")) for x in (left, right)))

        fitting = F.filter(sizes, lambda j: F.pow(F.lit(2.0), j) <= high - low)
        return F.filter(F.flatten(F.transform(fitting, of)), lambda x: x["block"].isNotNull())

    # explode_outer: a span always has a block, and explode() would have them made again to test for none.
    spans = known.groupBy(*own, "_s", "_e").agg(F.min("_v").alias("_v"))
    held = spans.withColumn("_b", F.explode_outer(blocks(F.col("_s"), F.col("_e")))).select(*own, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"), "_v")
    held = held.groupBy(*own, "_level", "_block").agg(F.min("_v").alias("_v"))
    whole = " and ".join(f"`{k}` is not null" for k in [*keys, date])
    asked = df.where(whole).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(date).cast("date").alias("_day")).distinct()
    asked = asked.withColumn("_level", F.explode(sizes)).withColumn("_block", F.floor(F.unix_date("_day") / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    first = asked.join(held, [*own, "_level", "_block"]).groupBy(*own, "_day").agg(F.min("_v").alias("_v"))
    first = first.select(*own, "_day", F.col("_v.n").alias(out))
    back = F.col(date).cast("date") == F.col("_day")
    for k in keys:
        back = back & (F.col(k) == F.col(f"_{k}"))
    return df.join(first, back, "left").drop("_day", *own)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key by order; null keys are equal."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_success(df: DataFrame, key: str, error: str, seq: str) -> DataFrame:
    """One row a key: successes before errors, then the latest; an aggregate, so it combines before the shuffle."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(F.col(error).isNull(), F.col(seq))).alias("_row"))
    return best.select(key, "_row.*")


def dense_id(df: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """0, 1, ... in the order of columns, by range partitions: only the partitions' sizes meet in one place.

    The dealt rows are written once, as ids need the same ranges when they are counted and when they are numbered.
    """
    parts = files.spooled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_k", F.monotonically_increasing_id()), "dealt").withColumn("_p", F.shiftright("_k", 33))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(starts.drop("_n")), "_p").withColumn(out, F.col("_start") + F.col("_k") - F.col("_first")).drop("_p", "_k", "_first", "_start")


def outer_series(series: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full outer join of series on key as one union and pivot."""
    union = None
    for name, df in series.items():
        part = df.select(key, F.lit(name).alias("_s"), F.col(value).alias("_v"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).pivot("_s", list(series)).agg(F.max("_v"))


def weighted_centred_mean(df: DataFrame, keys: list[str], order: str, value: str, n: str, out: str = "smooth", least: int = 5) -> DataFrame:
    """Mean over the row before, itself and the one after, weighted by n; rows of fewer than least observations are left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1)
    return df.where(F.col(n) >= least).withColumn(out, F.sum(F.col(n) * F.col(value)).over(w) / F.sum(n).over(w))


def centred_mean(df: DataFrame, keys: list[str], order: str, value: str, radius: int = 3, out: str = "smooth") -> DataFrame:
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)))


def coder_pairs(df: DataFrame, packet: str, coder: str, label: str) -> DataFrame:
    """coder_a < coder_b with their labels for every packet both coded."""
    a, b = df.select(packet, F.col(coder).alias("coder_a"), F.col(label).alias("label_a")), df.select(packet, F.col(coder).alias("coder_b"), F.col(label).alias("label_b"))
    return a.join(b, packet).where("coder_a < coder_b")


def crosstab(df: DataFrame, row: str, col: str, values: list, share: bool = False) -> DataFrame:
    """Counts (or shares of the row) by the given column values; null keys do not count."""
    counts = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row).agg(F.count("*").alias("total"), *(F.count_if(F.col(col) == v).alias(f"{col}_{v}") for v in values))
    return counts if not share else counts.select(row, *((F.col(f"{col}_{v}") / F.col("total")).alias(f"{col}_{v}") for v in values))


def category_counts(df: DataFrame, by: list[str], col: str, allowed: list[str]) -> DataFrame:
    """Counts of the allowed values, other_or_missing and total by group."""
    c = F.col(col)
    return df.groupBy(*by).agg(*(F.count_if(c == v).alias(f"n_{v}") for v in allowed), F.count_if(c.isNull() | ~c.isin(allowed)).alias("other_or_missing"), F.count("*").alias("total"))


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, cast; those that df lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def validated(df: DataFrame, allowed: dict[str, list[str]], fold=lambda c: c) -> tuple[DataFrame, DataFrame]:
    """df with values outside of each column's allowed set (after fold) blank, and column, value, n of what was rejected."""
    folded = df.withColumns({c: F.coalesce(fold(F.col(c)), F.lit("")) for c in allowed})
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.when((F.col(c) != "") & ~F.col(c).isin(values), F.col(c)).alias("value")) for c, values in allowed.items()))
    rejected = folded.select(F.explode(each).alias("x")).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    return folded.withColumns({c: F.when(F.col(c).isin(values), F.col(c)).otherwise("") for c, values in allowed.items()}), rejected


def labelled(packets: DataFrame, keys: DataFrame, corpus: DataFrame, packet: str, article: str, label: str) -> DataFrame:
    """packets with a label: the key file's, else the corpus's by article; null if neither has one."""
    by_packet = keys.select(packet, F.col(label).alias("_key")).dropDuplicates([packet])
    by_article = corpus.select(article, F.col(label).alias("_corpus")).dropDuplicates([article])
    out = packets.join(by_packet, packet, "left").join(by_article, article, "left")
    return out.withColumn(label, F.coalesce(F.when(F.trim("_key") != "", F.col("_key")), "_corpus")).drop("_key", "_corpus")
