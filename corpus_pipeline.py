"""Cleaning a corpus in stages; each works on all that the stage before it kept.

run(spark, sf_dir) applies STAGES to the table documents.  Each stage's result is written as Parquet and read again as the
next one's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import byte_bpe, cnn, common, decontaminate, jaccard_join, secrets

#: Near duplicates: five words, similarity in hundredths.
WORDS, PERCENT = 5, 80
CACHE = 30_000  #: keys of the encoder's memos: executors' memory is fuller here than in an encoding job
QUALITY = 0.5  #: least probability of a document that stays
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects; it is fitted on the labels of the documents given.

    A null or empty text is scored as padding, like any other; repeated rows are judged each.
    """
    net = cnn.train(docs, common.table(spark, sf_dir, "labels"))
    return cnn.score(common.spread(docs.select(*COLUMNS)), net, "_quality").where(F.col("_quality") >= QUALITY).drop("_quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Rows of null doc_id are in no group and stay.  Of rows that repeat a doc_id and its text one stays, the first by its
    other columns; a doc_id's other texts stay with it.  What goes is listed by doc_id; where this list is counted to be
    short it is broadcast, so that texts do not move.
    """
    groups = jaccard_join.join(docs, WORDS, PERCENT).where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    listed = groups.agg(F.min(F.expr("component_id = doc_id")).alias("_first"), F.count("*").alias("_n")).where("not _first or _n > 1")
    listed = common.spool(listed.select("_id", "_first"), "listed")
    rows = docs.select(*COLUMNS).join(common.small(listed), F.col("doc_id") == F.col("_id"), "left")
    again = rows.where("_first").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("_rest"))
    return rows.where("_id is null").select(*COLUMNS).unionByName(again.select("doc_id", "text", "_rest.*"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark; null and empty texts hold none, repeated rows are judged each."""
    marked = decontaminate.mark(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return marked.where(F.size("item_ids") == 0).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind in angle brackets; overlapping spans go together, under the first one's kind.

    Null and empty texts stay as they are; repeated rows are masked each.
    """
    found = secrets.scan(docs.select(*COLUMNS), keep=COLUMNS)

    def step(a, x):
        gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        more = F.when(x["start"] >= a["at"], F.concat(gap, F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], more).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(masked)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' token ids: doc_id, lang, source, n_tokens, ids; fails where these do not decode to the text.

    A null text has no ids, like an empty one; repeated rows are encoded each.
    """
    import public_tokenizers

    where = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), *where, verify=True, cache=CACHE)
    return ids.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("without_secrets", without_secrets), ("encoded", encoded)]
#: No stage but the secrets can be written in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = common.spool(stage(spark, docs, sf_dir), name)
        common.drop(*before)
        before = [docs]
    return docs
