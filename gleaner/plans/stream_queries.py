"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..sources import files
from ..streaming import jobs
from .registry import query


def stream(t, name: str):
    """A table's file as a stream of one trigger."""
    schema, path = getattr(t, name).schema, t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.dir}/{name}.parquet")
    reader = t.spark.readStream.schema(schema)
    if path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{t.dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.dir)  # streams read folders


@query("snk04_snk08_streaming_scores", r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as n from documents")
def _(t):
    out, checkpoint = files.scratch(t.spark, "scores"), files.scratch(t.spark, "checkpoint")
    jobs.append_records(stream(t, "documents"), lambda df: df.select("doc_id", text.word_count(F.col("text")).alias("n"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("seq")), out, checkpoint).awaitTermination()
    return jobs.current(t.spark, out, "doc_id", "error", "seq").select("doc_id", "n")


@query("stream_windowed_counts", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by all")
def _(t):
    out, checkpoint = files.scratch(t.spark, "windows"), files.scratch(t.spark, "checkpoint")

    def write(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    counts = jobs.windowed_counts(stream(t, "events"), "ts", "event_type")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = t.spark.read.parquet(out)
    newest = last.agg(F.max("batch").alias("b"))
    return last.join(F.broadcast(newest), F.col("batch") == F.col("b")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")  # newest is one row
