"""Queries of pattern banks, provenance and coder tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as N
from ..functions import scalars, text
from ..operators import stats as A
from ..sources import files
from .registry import query
from .text_queries import WORDS, count_of, hit_sql, placed

SENTENCES = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z"])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"""
LABELLED = "documents left join labels using (doc_id)"


NAMED = r"len(list_filter({0}, lambda x: list_contains(regexp_split_to_array(lower(x), '[^\p{{L}}\p{{Nd}}_]+'), '{1}')))"


@query("txt05_sco02_fallback_windows", f"select doc_id, case when was > 0 then was else the end as n, was > 0 as named from (select doc_id, {NAMED.format(SENTENCES, 'was')} as was, {NAMED.format(SENTENCES, 'the')} as the from documents)")
def _(t):
    named, generic = (text.windows(F.col("text"), p, 3) for p in (r"\bwas\b", r"\bthe\b"))
    return t.documents.select("doc_id", F.size(N.with_fallback(named, generic)).cast("long").alias("n"), (F.size(named) > 0).alias("named"))


@query("txt12_txt31_generic_references", f"select doc_id, {count_of('the', 'of')} as generic, {count_of('und', 'der')} as untracked from documents")
def _(t):
    return t.documents.select("doc_id", text.mentions(F.col("text"), ["the", "of"]).alias("generic"), text.mentions(F.col("text"), ["und", "der"]).alias("untracked"))


@query("txt13_veto", f"select doc_id, contains(lower(text), 'with') and not contains(lower(text), 'that') and not regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{Nd}}_])(da|mr|ms|district attorney)\\.? with([^\\p{{L}}\\p{{Nd}}_]|$)') as vetoed from documents")
def _(t):
    return t.documents.select("doc_id", N.vetoed(F.col("text"), "with", "that").alias("vetoed"))


BANK = (r"\b_P (?:the|and)\b", r"\b(?:is|was) _P\b")
BANK_SQL = " + ".join(f"cast(regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{Nd}}_]){p}([^\\p{{L}}\\p{{Nd}}_]|$)') as bigint)" for p in ("(that|this) (the|and)", "(is|was) (that|this)"))


@query("txt17_txt18_pattern_bank", f"select doc_id, {BANK_SQL} as n from documents")
def _(t):
    return t.documents.select("doc_id", N.hits(F.col("text"), N.expand(BANK, ["that", "this"])).alias("n"))


SPLIT = r"'[^\p{L}\p{Nd}_]+'"


@query("txt19_cooccurrence", f"with s as (select doc_id, unnest({SENTENCES}) as s from documents) select d.doc_id as doc_id, coalesce(sum(len(list_filter(regexp_split_to_array(lower(s), {SPLIT}), lambda x: x in ('the', 'and'))) ) filter (list_contains(regexp_split_to_array(lower(s), {SPLIT}), 'that')), 0) as n from documents d left join s on d.doc_id = s.doc_id group by d.doc_id", longs="n")
def _(t):
    return t.documents.select("doc_id", N.cooccurrence(F.col("text"), r"\bthat\b", r"\b(?:the|and)\b").alias("n"))


@query("txt07_txt15_quoted_themes", hit_sql(f"select * from {placed('licensed? under')} union all select * from {placed('public', True)}", ("no", "not")))
def _(t):
    found, outside = text.pattern_hit(F.col("text"), (r"licensed? under", r"\bpublic\b"), ("no", "not"))
    return t.documents.select("doc_id", found.alias("found"), outside.alias("outside"))


@query("txt28_txt32_normalised_terms", "select item_id, contains(lower(text), 'ing') or contains(lower(text), 'ent') as any_term from benchmark")
def _(t):
    c = text.clean(F.col("text"))
    return t.benchmark.select("item_id", F.exists(F.array(F.lit("ing"), F.lit("ent")), lambda w: F.contains(c, w)).alias("any_term"))


@query("txt30_numbered_items", "select item_id, 1 as n, 'item' as class, string_split(text, chr(10))[1] as text from benchmark")
def _(t):
    built = F.concat(F.lit("head\n1. [item] "), F.col("text"))
    return t.benchmark.select("item_id", F.explode(N.numbered_items(built)).alias("i")).select("item_id", "i.n", "i.class", "i.text")


@query("txt38_relabel", "select lang, case lang when 'en' then 'english' when 'fr' then 'french' else lang end as name, count(*) as n from documents group by lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).select("lang", N.relabel(F.col("lang"), {"en": "english", "fr": "french"}).alias("name"), "n")


@query("txt29_tolerant_json", "select event_id, json_extract_string(props, '$.k') as k from events")
def _(t):
    return t.events.select("event_id", text.tolerant_json(F.col("props"))["k"].alias("k"))


@query("prj08_population_filter", f"select doc_id, quality from {LABELLED} where quality is not null and length(text) > 0")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").where(F.col("quality").isNotNull() & (F.length("text") > 0)).select("doc_id", "quality")


@query("prj12_coalesced_text", "select page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(trim(url), ''), 'no text') as body from pages")
def _(t):
    title = F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(""))
    return t.pages.select("page_id", F.coalesce(title, F.nullif(F.trim("url"), F.lit("")), F.lit("no text")).alias("body"))


@query("prj14_tenure_filter", "select o_orderkey from orders join customer on o_custkey = c_custkey where o_orderdate < case c_nationkey % 2 when 0 then timestamp '1997-01-01' else timestamp '1999-01-01' end")
def _(t):
    start = F.when(F.col("c_nationkey") % 2 == 0, F.lit("1997-01-01")).otherwise("1999-01-01")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where(F.to_date("o_orderdate") < F.to_date(start)).select("o_orderkey")


@query("prj07_prefix_columns", "select avg(l_quantity) as l_quantity, avg(l_extendedprice) as l_extendedprice, avg(l_discount) as l_discount, avg(l_tax) as l_tax from lineitem")
def _(t):
    names = [f.name for f in t.lineitem.schema if f.dataType.typeName() == "double" and f.name.startswith("l_")]
    return t.lineitem.agg(*(F.avg(c).alias(c) for c in names))


@query("sco14_provenance", f"select doc_id, coalesce(quality, toxic, 0) as v, case when quality is not null then 'quality' when toxic is not null then 'toxic' else 'none' end as origin from {LABELLED}")
def _(t):
    v, origin = N.provenance({"quality": F.col("quality"), "toxic": F.col("toxic")})
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(v, F.lit(0)).alias("v"), origin.alias("origin"))


@query("jon08_packet_join", "select l.doc_id as doc_id, l.quality, coalesce(d.lang, 'unknown') as lang from labels l left join documents d using (doc_id)")
def _(t):
    key = t.documents.withColumn("quality", F.lit(9)).drop("quality", "text")
    return t.labels.join(key, "doc_id", "left").select("doc_id", "quality", F.coalesce("lang", F.lit("unknown")).alias("lang"))


@query("agg17_totals_from_means", "select count(*) * avg(l_quantity) as total from lineitem")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m")).agg(F.sum(F.col("n") * F.col("m")).alias("total"))


@query("agg21_agg23_agreement_by_bucket", "select lang, count(*) as n, count_if(quality = toxic) / count(*) as agreement, count_if(quality = 1 and toxic = 1) as n_both from documents join labels using (doc_id) group by lang", longs="n_both")
def _(t):
    d = t.documents.join(t.labels, "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("n"), (F.count_if(F.col("quality") == F.col("toxic")) / F.count("*")).alias("agreement"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("n_both"))


HALF = "z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))"


@query("agg22_downgrade_rate", f"with c as (select source, count_if(quality = 0) as k, count(*) as n, 1.959963984540054::double as z from documents join labels using (doc_id) group by source) select source, k / n as rate, greatest(0.0, (k / n + z * z / (2 * n) - {HALF}) / (1 + z * z / n)) as low, least(1.0, (k / n + z * z / (2 * n) + {HALF}) / (1 + z * z / n)) as high from c", doubles="rate low high")
def _(t):
    c = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("k"), F.count("*").alias("n"))
    low, high = scalars.wilson(F.col("k"), F.col("n"))
    return c.select("source", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


@query("src11_glob_coders", "select lang as coder, count(*) as n from documents group by lang")
def _(t):
    path = files.scratch(t.spark, "coders")
    t.documents.select("doc_id", F.col("lang").alias("coder")).write.partitionBy("coder").csv(path)
    found = files.coder_of(t.spark.read.schema("doc_id long").option("recursiveFileLookup", True).csv(path))
    return found.groupBy("coder").agg(F.count("*").alias("n"))


@query("fig02_fig06_group_means", "select source, avg(n_chars) as mean, stddev_samp(n_chars) / sqrt(count(*)) as se, count(*) as n from documents group by source having count(*) >= 5")
def _(t):
    g = t.documents.groupBy("source").agg(F.avg("n_chars").alias("mean"), (F.stddev_samp("n_chars") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    return g.where("n >= 5")


@query("fig08_fig09_normalised_mix", "select event_type, user_id % 2 = 0 as even, count(*) / sum(count(*)) over (partition by user_id % 2 = 0) as share from events group by event_type, user_id % 2 = 0")
def _(t):
    e = t.events.groupBy((F.col("user_id") % 2 == 0).alias("even"), "event_type").agg(F.count("*").alias("n"))
    total = e.groupBy("even").agg(F.sum("n").alias("total"))
    return e.join(total, "even").select("event_type", "even", (F.col("n") / F.col("total")).alias("share"))


@query("fig10_density_grid", "select cast(floor(l_discount / 0.02) as bigint) as x, cast(floor(l_tax / 0.02) as bigint) as y, count(*) as n from lineitem group by 1, 2")
def _(t):
    return t.lineitem.groupBy(F.floor(F.col("l_discount") / 0.02).alias("x"), F.floor(F.col("l_tax") / 0.02).alias("y")).agg(F.count("*").alias("n"))


@query("fig13_fig14_method_agreement", f"with f as (select cast(list_contains({WORDS}, 'that') as int) + cast(list_contains({WORDS}, 'was') as int) + cast(contains(lower(text), 'license') as int) as n_methods from documents) select n_methods, count(*) as n from f group by n_methods")
def _(t):
    c = [text.mentions(F.col("text"), [w]) > 0 for w in ("that", "was")] + [F.contains(F.lower("text"), F.lit("license"))]
    return t.documents.groupBy(sum((x.cast("int") for x in c), F.lit(0)).alias("n_methods")).agg(F.count("*").alias("n"))


@query("fig04_fig17_monthly_by_group", "select o_orderstatus, cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as mean, count(*) as n from orders group by 1, 2")
def _(t):
    return A.monthly(t.orders, "o_orderdate", "o_totalprice", ["o_orderstatus"])
