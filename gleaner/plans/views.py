"""The stages as views and the column functions as SQL functions, for users who write SQL.

    views.register(tables)
    spark.sql("select source, avg(composite) from stage_scored group by source")

A stage's view is its plan, so SQL over it is optimised with it as one query.  A function is the SQL text of a column builder, so a call is
inlined by the optimizer like the builder itself; builders with lambda functions have no such text and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import scalars, text
from ..operators import relational as R
from ..operators import scoring as S


def sql_of(spark: SparkSession, build, arguments: dict[str, str]) -> tuple[str, str]:
    """SQL text and type of a column builder over named arguments."""
    df = spark.createDataFrame([], ", ".join(f"{k} {t}" for k, t in arguments.items())).select(build(*map(F.col, arguments)).alias("out"))
    out = df._jdf.queryExecution().analyzed().expressions().head().child().sql()
    if "lambdafunction(" in out:
        raise ValueError("builders with lambda functions have no SQL text")
    return out, df.schema["out"].dataType.simpleString()


def functions(config: Config = DEFAULT) -> dict:
    """name -> builder and arguments of the functions that are registered."""
    return {
        "clean_text": (text.clean, {"t": "string"}),
        "keyword_score": (lambda t: text.keyword_score(t, config.keywords), {"t": "string"}),
        "fold_label": (text.fold_label, {"label": "string"}),
        "stance_bucket": (lambda x: scalars.bucket(x, -config.negative_below), {"x": "double"}),
        "cohen_h": (scalars.cohen_h, {"p1": "double", "p2": "double"}),
        "wilson_low": (lambda k, n: scalars.wilson(k, n)[0], {"k": "bigint", "n": "bigint"}),
        "wilson_high": (lambda k, n: scalars.wilson(k, n)[1], {"k": "bigint", "n": "bigint"}),
        "region_of": (lambda source: R.first_match(source, config.publications), {"source": "string"}),
        **{f"frame_{name}": (lambda t, p=patterns: text.frame_fraction(t, p), {"t": "string"}) for name, patterns in config.frames},
        **{f"mentions_{e.name}": (lambda t, v=e.variants: text.mentions(t, v), {"t": "string"}) for e in config.entities},
    }


def register_functions(spark: SparkSession, config: Config = DEFAULT) -> None:
    for name, (build, arguments) in functions(config).items():
        body, kind = sql_of(spark, build, arguments)
        spark.sql(f"create or replace temporary function {name}({', '.join(f'{k} {t}' for k, t in arguments.items())}) returns {kind} return {body}")


def stages(documents: DataFrame, labels: DataFrame, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """The pipeline's stages, each from the one before: clean, relevant, attributed, scored; and the labels."""
    clean = documents.where(F.length(F.trim("text")) > 0).select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), "lang", F.trim("text").alias("body"))
    score = text.keyword_score(F.col("body"), config.keywords)
    relevant = clean.withColumn("keyword_score", score).where("keyword_score >= 2")
    attributed = relevant.withColumn("region", R.first_match(F.col("source"), config.publications)).withColumns({f"n_{e.name}": text.mentions(F.col("body"), e.variants) for e in config.entities})
    flags = S.theme_flags(F.col("body"), config)
    scored = attributed.join(labels, "doc_id").withColumns({"keywords": S.keyword_component(flags), "document": text.frame_fraction(F.col("body"), dict(config.frames)["narrative"])})
    values = {k: F.col(k) if k in ("keywords", "document") else F.lit(None).cast("double") for k in config.weights}
    composite, negative = S.composite(values, config)
    return {"labels": labels, "clean": clean, "relevant": relevant, "attributed": attributed, "scored": scored.withColumns({"composite": composite, "n_negative": negative})}


def register(spark: SparkSession, documents: DataFrame, labels: DataFrame, config: Config = DEFAULT) -> list[str]:
    """Register the functions, and the stages as temporary views stage_<name>; returns the views' names."""
    register_functions(spark, config)
    out = []
    for name, df in stages(documents, labels, config).items():
        df.createOrReplaceTempView(f"stage_{name}")
        out.append(f"stage_{name}")
    return out
