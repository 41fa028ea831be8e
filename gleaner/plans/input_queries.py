"""Queries over inputs on which an operator's rule matters: damaged files, missing marks, clashing keys and odd values."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as R
from ..operators import scoring as S
from ..sources import files
from ..streaming import jobs
from .registry import query
from .stream_queries import stream

MARKS = ["NA", "nan", "null", "", "N/A", "x", "None", "na", "Nan"]


@query("src02_na_tokens", f"select o_orderkey, case when o_orderkey % {len(MARKS)} in (5, 7, 8) then {MARKS!r}[cast(o_orderkey % {len(MARKS)} as bigint) + 1] end as mark, o_orderstatus from orders")
def _(t):
    marks = F.get(text.literal(MARKS), (F.col("o_orderkey") % len(MARKS)).cast("int"))
    return files.na_to_null(t.orders.select("o_orderkey", marks.alias("mark"), "o_orderstatus"))


@query("src07_config_lookup", "select r_name, 'v' || r_regionkey as value, 'none' as absent from region")
def _(t):
    path = files.scratch(t.spark, "config")
    nested = F.to_json(F.struct(F.struct(F.concat(F.lit("v"), "r_regionkey").alias("b"), F.col("r_name").alias("name")).alias("a")))
    t.region.select(nested.alias("value"), "r_name").write.partitionBy("r_name").text(path)
    return files.read_config(t.spark, f"{path}/*/*", {"r_name": "$.a.name", "value": "$.a.b", "absent": "$.a.c"}, "none")


@query("src01_src03_damaged_tsv", "select cast(item_id as varchar) as item_id, case when item_id % 4 = 2 then null else 'a \"quoted\"' || chr(10) || 'line' end as body, case when item_id % 4 in (1, 2) then null else 'p' || item_id end as publication from benchmark where item_id % 4 <> 3")
def _(t):
    """Quoted fields with line ends and doubled quotes, short rows, and rows with a field too many."""
    path, k = files.scratch(t.spark, "damaged"), F.col("item_id")
    body = '"a ""quoted""\nline"'
    line = F.when(k % 4 == 3, F.concat_ws("\t", F.lit("0"), k, F.lit(body), F.lit("p"), F.lit("more"))).when(k % 4 == 2, F.concat_ws("\t", F.lit("0"), k)).when(k % 4 == 1, F.concat_ws("\t", F.lit("0"), k, F.lit(body))).otherwise(F.concat_ws("\t", F.lit("0"), k, F.lit(body), F.concat(F.lit("p"), k)))
    head = t.spark.range(1).select(F.lit("\tItem_ID \tBody\tPublication").alias("value"))
    head.unionByName(t.benchmark.select(line.alias("value"))).coalesce(1).write.text(path)
    return files.clean_headers(files.read_tsv(t.spark, path, ["", " Item_ID", "Body ", "PUBLICATION"]), ["item_id", "body"])


@query("src05_corrupt_jsonl", "select event_id, event_type from events where event_id % 7 <> 0")
def _(t):
    path = files.scratch(t.spark, "corrupt")
    whole = F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(F.col("event_id") % 14 == 0, F.substring(whole, 1, 12)).when(F.col("event_id") % 7 == 0, F.lit("not json")).otherwise(whole).alias("value")).write.text(path)
    return files.read_jsonl(t.spark, path, "event_id long, event_type string")


@query("src06_csv_encodings", "select c_custkey, c_name || ' é ñ' as name from customer")
def _(t):
    """Files in UTF-8 with and without a mark, and in one byte a letter."""
    path, rows = files.scratch(t.spark, "encodings"), t.customer.select("c_custkey", F.concat("c_name", F.lit(" é ñ")).alias("name"))
    for k, (mark, encoding) in enumerate((("﻿", "UTF-8"), ("", "UTF-8"), ("", "ISO-8859-1"))):
        part = rows.where(F.col("c_custkey") % 3 == k).withColumnRenamed("c_custkey", f"{mark}c_custkey")
        part.coalesce(1).write.options(header=True, encoding=encoding).csv(f"{path}/{k}")
    found = files.read_csv_any_encoding(t.spark, f"{path}/*/*.csv")
    lines = found.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> '' and line <> 'c_custkey,name'")
    return lines.select(F.split_part("line", F.lit(","), F.lit(1)).cast("long").alias("c_custkey"), F.split_part("line", F.lit(","), F.lit(2)).alias("name"))


STEP = timedelta(minutes=10)
EPOCH = datetime(2024, 1, 1)


def service():
    """A capped search service: a record each ten minutes, urls that come again, characters that break its JSON, and a refusal
    of every other call."""
    calls = 0

    def call(start: datetime, stop: datetime) -> str:
        nonlocal calls
        calls += 1
        if calls % 2:
            raise ConnectionError("429")
        first, last = -(-(start - EPOCH) // STEP), -(-(stop - EPOCH) // STEP)
        rows = [f'{{"url": "https://e/{k % 700}", "seen": {k}, "title": "t{"_" if k % 10 else chr(1)}{k % 700}"}}' for k in range(first, min(last, first + 250))]
        return f'{{"articles": [{", ".join(rows)}]}}'

    return call


@query("src08_src09_capped_pull", "select 'https://e/' || (k % 700) as url, min(k) as seen, 't' || case when k % 10 = 0 then ' ' else '_' end || (k % 700) as title from (select unnest(range(0, 10 * 24 * 6)) as k) group by k % 700, k % 10")
def _(t):
    """Windows of two days hold 288 records, over the cap of 250: they are halved."""
    chunks = files.date_chunks(t.spark, "2024-01-01", "2024-01-10", 2)
    windows = chunks.select(F.col("from_date").cast("timestamp_ntz").alias("start"), F.date_add("to_date", 1).cast("timestamp_ntz").alias("stop"))
    return files.pull(windows, service, "url string, seen long, title string", wait=lambda k: 0)


@query("jon10_resume", "select doc_id from documents where doc_id % 3 <> 0")
def _(t):
    """Progress in JSON lines, some of them damaged, is read back; what it lacks is pending."""
    path, k = files.scratch(t.spark, "progress"), F.col("doc_id")
    done = t.documents.where(k % 3 <= 1).select(F.when(k % 3 == 0, F.to_json(F.struct("doc_id"))).otherwise(F.lit('{"doc_id": ')).alias("value"))
    done.write.text(path)
    return jobs.pending(t.documents.select("doc_id"), files.read_jsonl(t.spark, path, "doc_id long"), "doc_id")


@query("jon14_label_with_fallback", "select doc_id, case when doc_id % 3 = 0 then 'key' when doc_id % 10 <> 1 then lang end as lang from documents")
def _(t):
    k = F.col("doc_id")
    keys = t.documents.where(k % 3 <= 1).select("doc_id", F.when(k % 3 == 0, "key").otherwise(" ").alias("lang"), F.concat(F.lit("p"), k).alias("packet"))
    corpus = t.documents.where(k % 10 != 1).select("doc_id", "lang")
    packets = t.documents.select("doc_id", F.concat(F.lit("p"), k).alias("packet"))
    return R.labelled(packets, keys.drop("doc_id"), corpus, "packet", "doc_id", "lang").select("doc_id", "lang")


@query("ded05_distinct_on_four", "select distinct user_id, event_type, cast(ts as date) as day, value > 10 as high from events")
def _(t):
    e = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"), (F.col("value") > 10).alias("high"))
    return e.dropDuplicates(["user_id", "event_type", "day", "high"])


@query("set02_column_concat", "select doc_id, length(text) as n_text, length(source) as n_source, lang = 'en' as english from documents", longs="n_text n_source")
def _(t):
    """Columns made apart are put side by side; rows are never aligned by position."""
    made = [{"n_text": F.length("text").cast("long")}, {"n_source": F.length("source").cast("long")}, {"english": F.col("lang") == "en"}]
    return t.documents.withColumns({k: c for part in made for k, c in part.items()}).select("doc_id", *(k for part in made for k in part))


@query("map02_validated_labels", "select count_if(v = '1_urgent') as urgent, count_if(v = '2_high') as high, count_if(v not in ('1_urgent', '2_high')) as blank, any_value(rejected) as rejected from (select replace(lower(o_orderpriority), '-', '_') as v from orders), (select string_agg(v || '=' || n, ', ' order by v) as rejected from (select replace(replace(lower(o_orderpriority), '-', '_'), ' ', '_') as v, count(*) as n from orders where left(o_orderpriority, 1) not in ('1', '2') group by 1))", longs="urgent high blank")
def _(t):
    kept, rejected = R.validated(t.orders.select("o_orderpriority"), {"o_orderpriority": ["1_urgent", "2_high"]}, text.fold_label)
    p = F.col("o_orderpriority")
    listed = rejected.agg(F.array_join(F.array_sort(F.collect_list(F.concat("value", F.lit("="), "n"))), ", ").alias("rejected"))  # a row a value
    return kept.agg(F.count_if(p == "1_urgent").alias("urgent"), F.count_if(p == "2_high").alias("high"), F.count_if(p == "").alias("blank")).crossJoin(listed)  # two single rows


def extractions(t):
    """Events as extractions of their users, with attributes in odd spellings, unknown and missing."""
    k, e = F.col("event_id"), F.col("event_type")
    kind = F.when(e == "click", "claim").when(e == "view", "imbalance").when(e == "error", "loaded").when(e == "signup", "missing_context")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int"))
    attributes = {"evidence": pick(" None", "anonymous_source", "named"), "blame": pick("Yes", "no"), "stance": pick("Critical ", "supportive", None, "odd"), "target": pick("entity", "policy", "other"), "valence": pick("Unfavorable", "favorable", None, "strange")}
    one = F.struct(kind.alias("class"), F.create_map(*(x for n, v in attributes.items() for x in (F.lit(n), v))).alias("attributes"))
    listed = t.events.groupBy("user_id").agg(F.collect_list(F.when(kind.isNotNull(), one)).alias("found"))
    return S.flat_extractions(listed, "user_id", "found")


EXTRACTIONS = "(select user_id, event_id as k, case event_type when 'click' then 'claim' when 'view' then 'imbalance' when 'error' then 'loaded' when 'signup' then 'missing_context' end as class, ['critical', 'supportive', null, 'odd'][event_id % 4 + 1] as stance, ['unfavorable', 'favorable', null, 'strange'][event_id % 4 + 1] as valence from events)"


@query("sco10_indicator_counts", f"select user_id, count_if(class is not null) as n_total, count_if(class = 'claim') as n_claims, count_if(class = 'claim' and k % 3 < 2) as n_claims_severe, count_if(class = 'claim' and k % 2 = 0) as n_blame, count_if(class = 'imbalance' and stance = 'critical') as n_critical, count_if(class = 'imbalance' and stance = 'supportive') as n_supportive, count_if(class = 'loaded') as n_loaded, count_if(class = 'loaded' and k % 3 < 2 and k % 4 <> 1) as n_loaded_negative, count_if(class = 'loaded' and k % 3 < 2 and k % 4 = 1) as n_loaded_favorable, count_if(class = 'missing_context') as n_missing_context from {EXTRACTIONS} group by user_id", longs=" ".join(S.INDICATORS))
def _(t):
    return S.indicator_counts(extractions(t), "user_id")


@query("agg24_quality_counters", f"select case when class = 'loaded' then case when valence is null then 'legacy_no_valence' else 'unmapped_valence_strange' end else 'unmapped_stance_' || coalesce(stance, 'missing') end as reason, count(*) as n from {EXTRACTIONS} where class = 'loaded' and coalesce(valence, 'strange') = 'strange' or class = 'imbalance' and coalesce(stance, 'odd') = 'odd' group by 1")
def _(t):
    return S.quality_counters(extractions(t))


@query("stream_distinct_users", "select distinct user_id from events")
def _(t):
    out, checkpoint = files.scratch(t.spark, "distinct"), files.scratch(t.spark, "checkpoint")

    def write(batch, n):
        batch.select("user_id").write.mode("overwrite").parquet(f"{out}/batch={n}")

    jobs.distinct(stream(t, "events"), "user_id", "ts").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("user_id")
