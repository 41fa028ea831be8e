"""Structured Streaming: resumable append of scored records, latest-success-wins as keyed state, distinct records, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest_success


def append_records(stream: DataFrame, transform, path: str, checkpoint: str):
    """Append transform(batch) to a Parquet folder; a batch that is run again replaces its own folder, so rows come once."""

    def write(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str, error: str, seq: str) -> DataFrame:
    """One row a key of what was appended: successes before errors, then the latest."""
    return latest_success(spark.read.parquet(path).drop("batch"), key, error, seq)


def winners(stream: DataFrame, key: str, error: str, seq: str) -> DataFrame:
    """Latest-success-wins as keyed state: a row for each change of a key's winner (key, and the stream's other columns).

    The state of a key is its winner, as an aggregate, so rows combine before the shuffle and no key is handed out of the JVM.
    A success replaces an error and any success of a lower number; an error replaces an error of a lower number; of equal
    numbers the earlier trigger's stays.  Within a trigger current_timestamp() is one value, so a winner that has it is new.
    """
    columns = [c for c in stream.columns if c != key]
    now = F.unix_micros(F.current_timestamp())
    rows = stream.select(F.col(key).alias("_key"), F.struct(*columns).alias("_row"), F.struct(F.col(error).isNull().alias("good"), F.col(seq).alias("seq"), (-now).alias("early")).alias("_order"))
    held = rows.groupBy("_key").agg(F.max_by(F.struct("_row", (-F.col("_order.early")).alias("at")), F.col("_order")).alias("_w"))
    return held.where(F.col("_w.at") == now).select(F.col("_key").alias(key), *(F.col(f"_w._row.`{c}`").alias(c) for c in columns))


def append_changes(changes: DataFrame, path: str, checkpoint: str):
    """Write each trigger's changes to a folder of its own; a trigger that is run again replaces its folder."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row a key: its last change."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_r")).select(key, "_r.*")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def distinct(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
