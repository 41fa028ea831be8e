"""Registration of queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rounding import ROUNDED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rounded_as_sql(x: Column, digits: int = 6) -> Column:
    """round(x, digits) of a double as DuckDB computes it: x times a power of ten to the nearest whole number, halves away from
    zero, then back.  Spark rounds the shortest decimal form instead, which differs where the next digits are 5 or the product
    passes 2 to the 53rd."""
    x = x.cast("double")
    scaled, ten = F.abs(x) * F.lit(10.0**digits), F.lit(10.0**digits)
    whole = F.rint(scaled)
    whole = whole + F.when(scaled - whole == 0.5, 1.0).otherwise(0.0)
    return F.when(whole < float("inf"), F.signum(x) * whole / ten).otherwise(x)


#: Tables of texts: their rows cost far more than their bytes say.
TEXTS = {"documents", "pages"}


def spread(df: DataFrame) -> DataFrame:
    """Deal out a scan of fewer partitions than cores (a small file may be one row group); larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """The tables of a folder, by name; texts spread over the cores."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(df) if name in TEXTS else df


def query(name: str, sql: str | None = None, longs: str = "", doubles: str = ""):
    """Register f(tables) under a name; sql is its DuckDB equivalent.  longs and doubles are columns that DuckDB has in a wider
    type (sums and conditional counts as HUGEINT, arithmetic on literals as DECIMAL)."""
    if sql and (longs or doubles):
        casts = [f"cast({c} as {t}) as {c}" for names, t in ((longs, "bigint"), (doubles, "double")) for c in names.split()]
        sql = f"select * replace ({', '.join(casts)}) from ({sql}) as q"

    def add(f):
        rounded = ROUNDED.get(name, "").split()

        def run(spark: SparkSession, d: str) -> DataFrame:
            df = f(Tables(spark, d))
            return df.withColumns({c: rounded_as_sql(F.col(c)) + 0.0 for c in rounded}) if rounded else df

        QUERIES[name] = run
        if sql:
            SQL[name] = sql if not rounded else f"select * replace ({', '.join(f'round({c}, 6) + 0.0 as {c}' for c in rounded)}) from ({sql}) as r"
        return f

    return add
