"""Queries of projections, text functions, attribution and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT as C
from ..functions import scalars, text
from ..operators import relational as R
from ..operators import scoring as S
from ..sources import files
from .registry import query

#: Words of a text in DuckDB, by the same notion of a word as \b in the regular expressions here.
WORDS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}_]+')"


def count_of(*variants: str, words: str = WORDS) -> str:
    return "+".join(f"len(list_filter({words}, lambda x: x = '{v}'))" for v in variants)


HEAD = r"regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{Nd}_]+')"


def articles(t):
    """documents as articles: the first line is the headline."""
    return t.documents.select("doc_id", "text", "source", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"))


@query("prj01_prj03_clean_project", "select doc_id, coalesce(lang, 'unknown') as lang, concat_ws(' | ', source, lang) as origin, trim(text) as body from documents where length(trim(text)) > 0")
def _(t):
    return t.documents.where(F.length(F.trim("text")) > 0).select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.concat_ws(" | ", "source", "lang").alias("origin"), F.trim("text").alias("body"))


@query("prj02_lenient_date", "select o_orderkey, try_cast(case when o_orderkey % 3 = 0 then null else o_orderdate end as timestamp) as ts from orders")
def _(t):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("not a date")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return t.orders.select("o_orderkey", files.lenient_date(raw).cast("timestamp_ntz").alias("ts"))


@query("prj04_dense_id", "select doc_id, row_number() over (order by source, doc_id) - 1 as id from documents")
def _(t):
    return R.dense_id(t.documents.select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "id")


@query("prj05_clean_text", r"""select doc_id, trim(regexp_replace(translate(lower(text), '‘’“”', '''''""'), '[\s\x{0b}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) as clean from documents""")
def _(t):
    return t.documents.select("doc_id", text.clean(F.col("text")).alias("clean"))


@query("prj06_first_words", r"with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents) select doc_id, case when len(w) <= 20 then text else array_to_string(w[1:20], ' ') || ' [...]' end as short from w")
def _(t):
    return t.documents.select("doc_id", text.first_words(F.col("text"), 20, " [...]").alias("short"))


@query("prj09_group_split", "select source, count_if(quality = 1) as n_good, count_if(quality = 0) as n_bad, avg(case when quality = 1 then n_chars end) as chars_good from documents join labels using (doc_id) group by source", longs="n_bad n_good")
def _(t):
    d = t.documents.join(t.labels, "doc_id")
    return d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("quality") == 0).alias("n_bad"), F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("chars_good"))


@query("prj10_membership", "select doc_id, lang in ('en', 'fr') as listed from documents where doc_id not in (select doc_id from labels)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", F.col("lang").isin("en", "fr").alias("listed"))


@query("prj11_safe_numeric", "select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, try_cast(event_type as double) as none from events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("none"))


@query("prj13_stance_bucket", "select event_id, case when value - 30 <= -10 then 'critical' when value - 30 >= 10 then 'supportive' else 'neutral' end as bucket from events where value is not null")
def _(t):
    return t.events.where("value is not null").select("event_id", scalars.bucket(F.col("value") - 30, 10).alias("bucket"))


@query("prj15_excluded_windows", "select event_id from events where not (cast(ts as date) between date '2024-01-05' and date '2024-01-09' or cast(ts as date) between date '2024-01-20' and date '2024-01-21')")
def _(t):
    day = F.to_date("ts")
    return t.events.where(~(day.between("2024-01-05", "2024-01-09") | day.between("2024-01-20", "2024-01-21"))).select("event_id")


@query("prj16_quadrants", "select case when quality = 1 then 'good' else 'bad' end || '/' || case when toxic = 1 then 'toxic' else 'clean' end as quadrant, count(*) as n, count(*) / sum(count(*)) over () as share from labels group by 1")
def _(t):
    q = F.concat(F.when(F.col("quality") == 1, "good").otherwise("bad"), F.lit("/"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    counts = t.labels.groupBy(q.alias("quadrant")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select("quadrant", "n", (F.col("n") / F.col("_t")).alias("share"))  # one row


@query("txt01_keyword_score", rf"select doc_id, cast(list_contains({WORDS}, 'the') as bigint) + cast(list_contains({WORDS}, 'are') as bigint) + cast(list_contains({WORDS}, 'mit') as bigint) + cast(contains(lower(text), 'license') as bigint) + cast(contains(lower(text), 'token') as bigint) + cast(contains(lower(text), 'stupid') as bigint) + cast(contains(lower(text), 'ing ') as bigint) + cast(regexp_matches(lower(text), '(^|[^\p{{L}}\p{{Nd}}_])on [\p{{L}}\p{{Nd}}_]') as bigint) + cast(contains(lower(text), 'public') as bigint) as score from documents")
def _(t):
    return t.documents.select("doc_id", text.keyword_score(F.col("text"), C.keywords).alias("score"))


@query("txt02_sentence_counts", r"""select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z"])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ') <> '')) as n from documents""")
def _(t):
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))


@query("txt03_sentence_windows", r"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z"])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') as s from documents), e as (select doc_id, s, unnest(range(1, len(s) + 1)) as i from s), h as (select doc_id, array_to_string(s[greatest(i - 1, 1):least(i + 1, len(s))], ' ') as w from e where list_contains(regexp_split_to_array(lower(s[i]), '[^\p{L}\p{Nd}_]+'), 'that')) select doc_id, count(*) as n, sum(length(w)) as chars from h group by doc_id""", longs="chars")
def _(t):
    w = t.documents.select("doc_id", F.explode(text.windows(F.col("text"), r"\bthat\b", 3)).alias("w"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("w")).cast("long").alias("chars"))


@query("txt10_mention_counts_long", " union all ".join(f"select doc_id, '{e.name}' as entity, {count_of(*e.variants)} as body_n, {count_of(*e.variants, words=HEAD)} as headline_n from documents" for e in C.entities))
def _(t):
    m = S.mention_array(articles(t), C, "text", "headline")
    return m.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.entity", "m.body_n", "m.headline_n")


@query("txt10_mention_counts_wide", "select doc_id, " + ", ".join(f"{count_of(*e.variants)} as mentions_{e.name}" for e in C.entities) + " from documents")
def _(t):
    return t.documents.select("doc_id", *(text.mentions(F.col("text"), e.variants).alias(f"mentions_{e.name}") for e in C.entities))


@query("txt14_paragraph_filter", rf"select doc_id, len(list_filter(string_split(text, chr(10)), lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')) > 10 and list_contains(regexp_split_to_array(lower(p), '[^\p{{L}}\p{{Nd}}_]+'), 'that'))[1:8]) as n from documents")
def _(t):
    return t.documents.select("doc_id", F.size(text.paragraphs(F.col("text"), r"\bthat\b")).cast("long").alias("n"))


def frame_sql() -> str:
    def has(p):
        p = p.replace(r"\b", "")
        return "contains(lower(text), '|')" if p == r"\|" else "(" + " or ".join(f"list_contains({WORDS}, '{v}')" for v in (("license", "licensed") if p == "licensed?" else (p,))) + ")"

    return ", ".join("(" + " + ".join(f"cast({has(p)} as double)" for p in patterns) + f") / {len(patterns)} as frame_{name}" for name, patterns in C.frames)


@query("txt16_frame_fraction", f"select doc_id, {frame_sql()} from documents")
def frames(t):
    return t.documents.select("doc_id", *(text.frame_fraction(F.col("text"), p).alias(f"frame_{n}") for n, p in C.frames))


@query("sco06_dominant_frame", f"with f as (select doc_id, {frame_sql()} from documents) select doc_id, case when greatest(frame_legal, frame_technical, frame_narrative) = 0 then null when frame_legal >= greatest(frame_technical, frame_narrative) then 'frame_legal' when frame_technical >= frame_narrative then 'frame_technical' else 'frame_narrative' end as dominant from f")
def _(t):
    return frames(t).select("doc_id", text.argmax([f"frame_{n}" for n, _ in C.frames]).alias("dominant"))


@query("txt09_fraction_quoted", r"""select doc_id, case when length(text) > 0 then coalesce(list_sum(list_transform(regexp_extract_all(text, '"[^"]{2,600}"|“[^“”]{2,600}”'), lambda x: length(x))), 0) / length(text) else 0 end as share from documents""")
def _(t):
    return t.documents.select("doc_id", text.fraction_quoted(F.col("text")).alias("share"))


@query("txt22_blocks", r"with b as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') as b, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as l from documents) select doc_id, case when len(b) > 1 then len(b) else len(l) end as n from b")
def _(t):
    return t.documents.select("doc_id", F.size(text.blocks(F.col("text"))).cast("long").alias("n"))


@query("txt23_truncate", "select item_id, case when length(text) <= 120 then text else rtrim(left(text, 117), ' ') || '...' end as short from benchmark")
def _(t):
    return t.benchmark.select("item_id", text.truncate(F.col("text"), 120).alias("short"))


LONG = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9_]+'), lambda w: length(w) > 3))"


@query("txt24_overlap", f"with p as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as next from conversations) select conv_id, turn, case when len({LONG.format('text')}) > 0 then len(list_intersect({LONG.format('text')}, {LONG.format('next')})) / len({LONG.format('text')}) else 0 end as score from p where next is not null")
def _(t):
    from pyspark.sql import Window

    p = t.conversations.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return p.select("conv_id", "turn", text.overlap(F.col("text"), F.col("next")).alias("score"))


@query("txt25_txt26_context")
def _(t):
    return t.documents.select("doc_id", text.best_block(F.col("text"), F.col("source")).alias("context"), text.focus(F.col("text"), r"\b(?:that|was)\b").alias("focus"))


@query("txt27_grounded", "with i as (select item_id, text from benchmark), x as (select item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as q, trim(regexp_replace(lower('Before. ' || left(text, 60)), '\\s+', ' ', 'g')) as d from i) select item_id, contains(d, q) or (len(string_split(q, ' ')) >= 5 and contains(d, array_to_string(string_split(q, ' ')[1:8], ' '))) as grounded from x")
def _(t):
    return t.benchmark.select("item_id", text.grounded(F.concat(F.lit("Before. "), F.left("text", F.lit(60))), F.col("text")).alias("grounded"))


@query("txt21_fold_label", r"select distinct o_orderpriority, regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[\s\-]+', '_', 'g'), '^(\d+)\.0+$', '\1') as folded from orders")
def _(t):
    return t.orders.select("o_orderpriority", text.fold_label(F.col("o_orderpriority")).alias("folded")).distinct()


@query("txt20_fold_attribute", "select doc_id, cast(quality = 1 as varchar) as quality, lower(lang) as lang from labels join documents using (doc_id)")
def _(t):
    d = t.labels.join(t.documents, "doc_id")
    return d.select("doc_id", text.fold_attribute(F.when(F.col("quality") == 1, " Yes").otherwise("NO ")).alias("quality"), text.fold_attribute(F.upper("lang")).alias("lang"))


@query("txt33_domain", r"select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') as domain from pages")
def _(t):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", "").alias("domain"))


@query("txt35_word_count", r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as n from documents")
def _(t):
    return t.documents.select("doc_id", text.word_count(F.col("text")).alias("n"))


@query("txt36_txt39_note_flags", "select count_if(contains(lower(text), 'license')) as licensed, count_if(regexp_matches(text, '\\bAND\\b')) as shouted, count_if(contains(text, '|')) as tabular, count_if(contains(lower(text), 'token =')) as secret from documents", longs="licensed secret shouted tabular")
def _(t):
    return t.documents.agg(F.count_if(F.lower("text").contains("license")).alias("licensed"), F.count_if(F.regexp_like("text", F.lit(r"\bAND\b"))).alias("shouted"), F.count_if(F.col("text").contains("|")).alias("tabular"), F.count_if(F.lower("text").contains("token =")).alias("secret"))


WORDLY = r"[\p{L}\p{N}_]"


def placed(pattern: str, word: bool = False, source: str = "select doc_id, text as t from documents") -> str:
    """SQL: doc_id, t, s and e (offsets from 0) of a pattern's matches; word: only where no other letter or digit touches."""
    lists = f"select doc_id, t, string_split_regex(t, '(?i){pattern}') as q, regexp_extract_all(t, '(?i){pattern}') as m from ({source})"
    each = f"select doc_id, t, cast(coalesce(list_sum(list_transform(q[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as bigint) as s, length(m[k]) as n from (select *, unnest(range(1, len(m) + 1)) as k from ({lists}))"
    alone = f" where (s = 0 or not regexp_matches(substr(t, s, 1), '{WORDLY}')) and not regexp_matches(substr(t, s + n + 1, 1), '{WORDLY}')" if word else ""
    return f"(select doc_id, t, s, s + n as e from ({each}){alone})"


def hit_sql(matches: str, negators, phrases=()) -> str:
    """SQL: found and outside of every document, from placed() matches."""
    tokens = f"regexp_extract_all(lower(substr(t, 1, s)), '[\\p{{L}}\\p{{N}}_'']+')[-{text.BEFORE}:]"
    told = " or ".join([f"list_has_any(w, [{', '.join(repr(n) for n in negators)}])", *(f"contains(array_to_string(w, ' '), '{p}')" for p in phrases)])
    quotes = placed(text.QUOTE).replace("(?i)", "")
    plain = f"select * from (select doc_id, s, {tokens} as w from ({matches})) where not ({told})"
    outside = f"select distinct p.doc_id from ({plain}) p where not exists (select 1 from {quotes} q where q.doc_id = p.doc_id and q.s <= p.s and p.s < q.e)"
    return f"select doc_id, doc_id in (select doc_id from ({plain})) as found, doc_id in ({outside}) as outside from documents"


@query("txt06_negation_quotes", hit_sql(f"select * from {placed('that', True)} union all select * from {placed('was', True)}", C.negators, C.negating_phrases))
def _(t):
    found, outside = text.pattern_hit(F.col("text"), (r"\bthat\b", r"\bwas\b"), C.negators, C.negating_phrases)
    return t.documents.select("doc_id", found.alias("found"), outside.alias("outside"))


@query("txt08_hits_inside_quotes", f"select d.doc_id, count(distinct m.s) as n, count(distinct case when m.s >= q.s and m.s < q.e then m.s end) as n_quoted from documents d left join {placed('the', True)} m on d.doc_id = m.doc_id left join {placed(text.QUOTE).replace('(?i)', '')} q on d.doc_id = q.doc_id group by d.doc_id")
def _(t):
    both = text.let(F.struct(text.positions(F.col("text"), r"(?i)\bthe\b").alias("m"), text.positions(F.col("text"), text.QUOTE).alias("q")), lambda b: F.struct(F.size(b["m"]).cast("long").alias("n"), F.size(F.filter(b["m"], lambda x: text.inside(x["start"], b["q"]))).cast("long").alias("n_quoted")))
    return t.documents.select("doc_id", both.alias("b")).select("doc_id", "b.*")


CONTEXT = r"\blicen[cs]e|\btoken\b|\bpublic\b"
CONTEXT_SQL = r"(^|[^\p{L}\p{N}_])(licen[cs]e|(token|public)([^\p{L}\p{N}_]|$))"


def gated_sql(source: str, around: int) -> str:
    m = placed("the", True, source)
    return f"select doc_id, count(*) as n from {m} where regexp_matches(lower(substr(t, greatest(s - {around}, 0) + 1, e + {around} - greatest(s - {around}, 0))), '{CONTEXT_SQL}') and not contains(lower(substr(t, greatest(s - 20, 0) + 1, e - greatest(s - 20, 0))), 'of the') group by doc_id"


@query("txt11_gated_mentions", f"select doc_id, coalesce(b.n, 0) as body_n, coalesce(h.n, 0) as headline_n from documents left join ({gated_sql('select doc_id, text as t from documents', 300)}) b using (doc_id) left join ({gated_sql('select doc_id, split_part(text, chr(10), 1) as t from documents', 100)}) h using (doc_id)")
def _(t):
    return articles(t).select("doc_id", *(text.gated_mentions(F.col(c), "the", CONTEXT, "of", around).alias(n) for c, n, around in (("text", "body_n", 300), ("headline", "headline_n", 100))))


def centrality_sql() -> str:
    m = placed("that", True)
    flags = f"select doc_id, count(*) as n, count_if(regexp_matches(substr(t, greatest(s - 30, 0) + 1, least(s, 30)), '(?i){text.SOURCE_BEFORE}') or regexp_matches(substr(t, e + 1, 20), '(?i){text.SOURCE_AFTER}')) as told, count_if(s < 40 or regexp_matches(substr(t, s - 39, 40), '[.!?\\n]')) as opening from {m} group by doc_id"
    sentences = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z"])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"""
    has = "cast(list_contains(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), 'that') as double)"
    parts = f"select doc_id, coalesce(n, 0) as n, {has.format('split_part(text, chr(10), 1)')} as head, {has.format(f'array_to_string({sentences}[1:3], chr(32))')} as lede, 100.0::double * coalesce(n, 0) / greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) as x, coalesce(1 - told / n, 0) as plain, coalesce(opening / n, 0) as subject from documents left join ({flags}) using (doc_id)"
    return f"select doc_id, n, head, lede, x / (x + 1) as density, plain, subject, round(0.25 * head + 0.15 * lede + 0.20 * x / (x + 1) + 0.25 * plain + 0.15 * subject, 4) as total from ({parts})"


@query("txt34_centrality", centrality_sql(), doubles="total density plain subject")
def _(t):
    return articles(t).select("doc_id", *(c.alias(k) for k, c in text.centrality(F.col("headline"), F.col("text"), r"\bthat\b").items()))


BODY = {e.name: f"({count_of(*e.variants)} + 3 * ({count_of(*e.variants, words=HEAD)}))" for e in C.entities}
LONG_SQL = " union all ".join(f"select doc_id, '{e.name}' as entity, {k} as ord, {count_of(*e.variants)} as b, {count_of(*e.variants, words=HEAD)} as h from documents" for k, e in enumerate(C.entities))


@query("sco04_primary_argmax", f"with m as ({LONG_SQL}), r as (select *, row_number() over (partition by doc_id order by b + 3 * h desc, ord) as rn from m) select doc_id, case when b + 3 * h > 0 then entity end as entity from r where rn = 1")
def _(t):
    m = S.mention_array(articles(t), C, "text", "headline")
    return m.select("doc_id", S.primary_entity(F.col("mentions")).alias("entity"))


@query("sco12_relevance_rule", f"with m as ({LONG_SQL}) select doc_id, bool_or(entity = 'that' and (b >= 2 or h >= 1)) as relevant from m group by doc_id")
def _(t):
    return S.mention_array(articles(t), C, "text", "headline").select("doc_id", S.relevant(F.col("mentions"), F.lit("that")).alias("relevant"))


@query("sco13_win08_dominance", f"with m as ({LONG_SQL}) select doc_id, bool_or(entity = 'that' and (b >= 2 or h >= 1)) and sum(case when entity = 'that' then b else 0 end) > sum(case when entity <> 'that' then b else 0 end) as dominant from m group by doc_id")
def _(t):
    return S.mention_array(articles(t), C, "text", "headline").select("doc_id", S.dominant(F.col("mentions"), F.lit("that"), F.lit(0)).alias("dominant"))


@query("sco01_relevance_threshold", f"select doc_id, ({count_of('that')}) >= 1 and quality = 1 as is_relevant from documents join labels using (doc_id)")
def _(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", ((text.mentions(F.col("text"), ["that"]) >= 1) & (F.col("quality") == 1)).alias("is_relevant"))


def themes_sql(name: str) -> str:
    return "(" + " or ".join(f"contains(lower(text), '{p}')" for p in dict(C.themes)[name]) + ")"


@query("sco02_keyword_component", "select doc_id, " + ", ".join(f"{themes_sql(n)} as theme_{n}" for n, _ in C.themes) + ", -(" + " + ".join(f"cast({themes_sql(n)} as double)" for n, _ in C.themes) + f") / {len(C.themes)} as score from documents")
def _(t):
    flags = S.theme_flags(F.col("text"), C)
    return t.documents.select("doc_id", *(f.alias(f"theme_{n}") for n, f in flags.items()), S.keyword_component(flags).alias("score"))


VALUES = {"aspect": "case when event_id % 3 = 0 then null else sin(event_id) end", "stance": "case when event_id % 5 = 0 then null else cos(event_id) end", "keywords": "case when event_id % 15 = 0 then null else -value / 100 end", "document": "case when event_id % 2 = 0 and event_id % 15 <> 0 then value / 100 - 0.5 end"}
PRESENT = " + ".join(f"case when {k} is null then 0 else {w} end" for k, w in C.weights.items())


@query("sco03_composite_renorm", f"with v as (select event_id, {', '.join(f'{x} as {k}' for k, x in VALUES.items())} from events) select event_id, round(({' + '.join(f'coalesce({k}, 0) * {w}' for k, w in C.weights.items())}) / nullif({PRESENT}, 0), 9) as composite, {' + '.join(f'case when {k} < -0.1 then 1 else 0 end' for k in C.weights)} as n_negative from v")
def _(t):
    mean, n = S.composite({k: F.expr(x) for k, x in VALUES.items()}, C)
    return t.events.select("event_id", F.round(mean, 9).alias("composite"), n.cast("int").alias("n_negative"))


@query("sco07_sco08_theme_validation", """with h as (select event_id, least(5.0 * (event_id % 7), 25.0) as d, least(5.0 * (event_id % 3), 25.0) as r, case when event_id % 4 = 0 then 20.0 else 0.0 end as c, least(event_id % 11, 5) * 5.0 as o from events),
b as (select event_id, d * 0.30 + r * 0.35 + c * 0.15 + o * 0.20 as base, cast(d > 0 as int) + cast(r > 0 as int) + cast(c > 0 as int) + cast(o > 0 as int) as n from h)
select event_id, n, case when n >= 3 then 'High' when n = 2 then 'Medium' else 'Low' end as confidence, round(least(case when n < 2 then least(base, 15) when n = 2 then base * 1.1 else base * 1.25 end, 100), 1) as score from b""", doubles="score")
def _(t):
    e = F.col("event_id")
    scores = {"dict": S.method_score(e % 7), "regex": S.method_score(e % 3), "crit": F.when(e % 4 == 0, 20.0).otherwise(0.0), "cooc": F.least(e % 11, F.lit(5)) * 5.0}
    score, n, confidence = S.validate_themes(scores, C)
    return t.events.select("event_id", n.cast("int").alias("n"), confidence.alias("confidence"), F.round(score + 1e-9, 1).alias("score"))


@query("sco09_indicator_score", "select user_id, count_if(event_type = 'error') as n_anti, count_if(event_type in ('purchase', 'signup')) as n_pro, case when least(count_if(event_type = 'error'), 30) > least(count_if(event_type in ('purchase', 'signup')), 30) then -least(count_if(event_type = 'error'), 30) / 30 when least(count_if(event_type = 'error'), 30) < least(count_if(event_type in ('purchase', 'signup')), 30) then least(count_if(event_type in ('purchase', 'signup')), 30) / 30 else 0 end as score from events group by user_id", longs="n_anti n_pro")
def _(t):
    c = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_anti"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("n_pro"))
    return c.withColumn("score", S.indicator_score(F.col("n_anti"), F.col("n_pro"), 30))
