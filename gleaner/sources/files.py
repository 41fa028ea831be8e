"""Sources and sinks."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks of missing values that the data-frame library's CSV reader knows.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "M/d/yyyy"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def spooled(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: its lineage is cut, and later jobs read it instead of making it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", null: str = "") -> DataFrame:
    """Strings from quoted, multi-line, headed files; rows with too many fields are skipped, short ones padded with null.

    Unquoted empty fields are null, and fields that equal the argument null, quoted or not: by default quoted empty ones as well.
    With a text that no field has (unlike()) what write_tsv() wrote comes back as it was.
    """
    return raw_tsv(spark, path, columns, sep, null=null).where("_overflow is null").drop("_overflow")


def raw_tsv(spark: SparkSession, path: str, columns: list[str], sep: str, header: bool = True, null: str = "") -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_overflow"]])
    return spark.read.options(sep=sep, header=header, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=True, nullValue=null, emptyValue="").schema(schema).csv(path)


def unlike() -> str:
    """A text that no given field has."""
    return uuid.uuid4().hex


def counted(df: DataFrame, bad: dict[str, Column], name: str = "counted") -> tuple[DataFrame, dict[str, int]]:
    """Rows that are bad in no way, written and read back, and how many were read (`read`), are bad in each way, and stay (`kept`).

    The counts are observed in the scan that writes the rows; there is no second pass.
    """
    ways = {k: F.coalesce(c, F.lit(False)) for k, c in bad.items()}
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    observed = df.withColumns({f"_bad_{k}": c for k, c in ways.items()}).observe(seen, F.count("*").alias("read"), *(F.count_if(F.col(f"_bad_{k}")).alias(k) for k in ways), F.count_if(kept_of(ways)).alias("kept"))
    out = spooled(observed.where(kept_of(ways)).select(*df.columns), name)
    return out, {k: int(v) for k, v in seen.get.items()}


def kept_of(ways) -> Column:
    out = F.lit(True)
    for k in ways:
        out = out & ~F.col(f"_bad_{k}")
    return out


def dated(df: DataFrame, text: str, out: str) -> tuple[DataFrame, dict[str, int]]:
    """Rows whose date can be read, with it as a timestamp, and the counts of counted() (bad: `undated`)."""
    return counted(df.withColumn(out, lenient_date(F.col(text))), {"undated": F.col(out).isNull()}, "dated")


def read_tsv_counted(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", header: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """read_tsv() with counts: rows of too many fields (`long`)."""
    rows, counts = counted(raw_tsv(spark, path, columns, sep, header), {"long": F.col("_overflow").isNotNull()}, "tsv")
    return rows.drop("_overflow"), counts


def read_jsonl_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict[str, int]]:
    """read_jsonl() with counts: damaged lines (`corrupt`)."""
    raw = spark.read.schema(f"{schema}, _corrupt string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path)
    rows, counts = counted(raw, {"corrupt": F.col("_corrupt").isNotNull()}, "jsonl")
    return rows.drop("_corrupt"), counts


def na_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.col(f.name).isin(NA_TOKENS), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema))


def clean_headers(df: DataFrame, required: list[str]) -> DataFrame:
    """Headers trimmed and lower-cased, unnamed ones dropped; ValueError if a required one is missing."""
    names = [c.strip().lower() for c in df.columns]
    out = df.toDF(*[n or f"_unnamed{k}" for k, n in enumerate(names)]).drop(*(f"_unnamed{k}" for k, n in enumerate(names) if not n), "unnamed: 0", "_c0")
    if missing := sorted(set(required) - set(out.columns)):
        raise ValueError(f"missing columns: {missing}")
    return out


def lenient_date(c: Column) -> Column:
    """Timestamp by the first of FORMATS that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in FORMATS))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; damaged lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """path, text of files in UTF-8 (with or without mark) or else Windows-1252."""

    @F.pandas_udf("string")
    def decoded(s):
        def one(b):
            for e in ("utf-8-sig", "cp1252"):
                try:
                    return bytes(b).decode(e)
                except UnicodeDecodeError:
                    pass
            return bytes(b).decode("utf-8", "replace")

        return s.map(one)

    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"))


def read_config(spark: SparkSession, path: str, lookups: dict[str, str], default: str = "") -> DataFrame:
    """One row of values by JSON path, with a default."""
    text = spark.read.text(path, wholetext=True)
    return text.select(*(F.coalesce(F.get_json_object("value", p), F.lit(default)).alias(n) for n, p in lookups.items()))


def coder_of(df: DataFrame) -> DataFrame:
    """coder, from the stem or the folder of each row's file."""
    path = F.col("_metadata.file_path")
    return df.withColumn("coder", F.coalesce(F.nullif(F.regexp_extract(path, r"coder=([^/]+)/", 1), F.lit("")), F.regexp_extract(path, r"([^/]+?)\.[a-z]+$", 1)))


#: Of separated files: white space around a field is kept, null is an empty field and an empty text a quoted one.
EXACT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "", "emptyValue": '""'}


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").options(**EXACT).csv(path)


def write_tsv(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.options(**EXACT, sep=sep).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested JSON lines, nulls written, other types by their string form."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_both(df: DataFrame, flag: str, path: str) -> None:
    """All rows, partitioned by a flag, so that either part is read alone."""
    df.write.mode("overwrite").partitionBy(flag).parquet(path)


def markdown(df: DataFrame, title: str, body: str) -> Column:
    return F.format_string("### %s\n\n> %s\n", F.col(title).cast("string"), F.regexp_replace(F.col(body), r"\s+", " "))


def latex_macro(name: Column, value: Column) -> Column:
    """A macro definition: p-values as <.001 or three places, whole numbers grouped, others with two places."""
    number = F.when(F.regexp_like(name, F.lit("^p[A-Z]")), F.when(value < 0.001, "<.001").otherwise(F.regexp_replace(F.format_number(value, 3), "^0", ""))).when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.concat(F.lit("\\newcommand{\\"), name, F.lit("}{"), number, F.lit("}"))


def date_chunks(spark: SparkSession, start: str, stop: str, days: int) -> DataFrame:
    """from_date, to_date of chunks of so many days."""
    df = spark.sql(f"select explode(sequence(date'{start}', date'{stop}', interval {days} days)) as from_date")
    return df.select("from_date", F.least(F.date_add("from_date", days - 1), F.to_date(F.lit(stop))).alias("to_date"))


def repaired_json(text: str, most: int = 100):
    """JSON of a text, characters that break it blanked one by one; an empty object if that does not help."""
    for _ in range(most):
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            text = text[: e.pos] + " " + text[e.pos + 1 :]
    return {}


def backoff(k: int) -> float:
    """Seconds to wait after k + 1 refusals in a row."""
    return min(10.0 * 2**k, 120.0)


def pull(windows: DataFrame, load, schema: str, field: str = "articles", cap: int = 250, depth: int = 8, least: timedelta = timedelta(hours=1), tries: int = 8, wait=backoff) -> DataFrame:
    """Records of a capped service for every window (start, stop), each window a partition of its own.

    load() gives call(start, stop) -> JSON text, once a task.  A call that raises OSError (refused, timed out) is made again after a
    wait, tries times at most.  A window with cap records or more is halved and asked again, down to depth halvings or the
    least length.  Records are distinct by url: the first by the schema's other columns stays.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load()

        def asked(a, b):
            for k in range(tries):
                try:
                    return repaired_json(call(a, b)).get(field) or []
                except OSError:
                    if k == tries - 1:
                        raise
                    time.sleep(wait(k))

        def within(a, b, left):
            rows = asked(a, b)
            if len(rows) < cap or left == 0 or b - a <= least:
                return rows
            mid = a + (b - a) / 2
            return within(a, mid, left - 1) + within(mid, b, left - 1)

        for frame in parts:
            for a, b in zip(frame["start"], frame["stop"], strict=True):
                yield pd.DataFrame([[r.get(n) for n in names] for r in within(a.to_pydatetime(), b.to_pydatetime(), depth)], columns=names)

    rows = windows.repartition(max(1, windows.count()), "start").mapInPandas(run, schema)
    rest = [n for n in names if n != "url"]
    return rows.groupBy("url").agg(F.min(F.struct(*rest)).alias("_r")).select("url", "_r.*").select(*names)
