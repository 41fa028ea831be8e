"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: The words of the contracts are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Rows in a batch where the session has Spark's own value: texts are long, and a batch stands in memory several times.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024")}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed on the executors' path; make batches smaller."""
    for key, (given, smaller) in BATCHES.items():
        if spark.conf.get(key) == given:
            spark.conf.set(key, smaller)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def spool(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared folder and read it back; drop() takes it away again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.spooled = path
    return out


def drop(*spools: DataFrame) -> None:
    """Remove spooled tables that nothing reads any more."""
    for df in spools:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df.spooled)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A spooled table of few and narrow columns, to be broadcast if it is counted to have at most so many rows; else Spark chooses the join."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input of fewer partitions than cores (one small file); larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sliced(batches, size: int = 4 << 20):
    """The same rows in batches of about size bytes, so that their Python objects stay small (a single long row stays whole)."""
    for b in batches:
        step = max(1, int(b.num_rows * size / max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


class Memo:
    """make(key), kept for the keys of late: two generations of at most so many keys, none longer than 64."""

    def __init__(self, most: int, make):
        self.most, self.make, self.young, self.old = most, make, {}, {}

    def find(self, key):
        if (value := self.young.get(key)) is None:
            if (value := self.old.get(key)) is None:
                value = self.make(key)
                if len(key) > 64:
                    return value
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value


def trim() -> None:
    """Give memory that was freed back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # the C library may be another one
        ctypes.CDLL(None).malloc_trim(0)


_held: dict = {}


def worker_table(key, make=lambda: None):
    """make(), kept in a Python worker until another operator asks for its own: workers outlive stages, and their tables add up."""
    if key not in _held:
        if _held:
            _held.clear()
            trim()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(expr, body):
    """body(x) with x bound once: keeps Catalyst from inlining a costly array into every lambda call."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def words_of(col):
    """Words of a text column; null gives an empty array."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
