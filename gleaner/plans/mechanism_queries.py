"""Queries of interval joins, densities, counted loads, keyed stream state, report files and SQL over the stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density
from ..operators import quantiles as Q
from ..operators import relational as R
from ..operators import sampling as P
from ..sources import files, report
from ..streaming import jobs
from . import views
from .registry import query

SPANS = "(select l_shipdate as s, case when l_orderkey % 997 <> 0 then l_shipdate + cast(cast(l_quantity as bigint) * case when l_orderkey % 50 = 0 then 40 else 1 end as int) * interval 1 day end as e, l_orderkey * 10 + l_linenumber as ord, l_partkey as name, '{0}' as k from lineitem)"


@query("jon03_sco05_interval_join", f"with d as {SPANS.format('all')}, f as (select distinct cast(o_orderdate as date) as day from orders), m as (select day, name, row_number() over (partition by day order by ord, name) as rn from f join d on s <= day and (e is null or day <= e)) select o_orderkey, name as found from orders left join m on m.day = cast(o_orderdate as date) and rn = 1")
def _(t):
    """All line items as intervals of one key, of some days or some years, a few of them open."""
    days = (F.col("l_quantity").cast("int") * F.when(F.col("l_orderkey") % 50 == 0, 40).otherwise(1)).cast("int")
    end = F.when(F.col("l_orderkey") % 997 != 0, F.date_add(F.to_date("l_shipdate"), days))
    dim = t.lineitem.select(F.to_date("l_shipdate").alias("start"), end.alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_partkey").alias("name"), F.lit("all").alias("k"))
    facts = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.lit("all").alias("k"))
    return R.interval_join(facts, dim, ["k"], "day").select("o_orderkey", "found")


PAD, CELLS, WIDTH = 0.08, 120, 0.3  # fixed values: padding of the axes, places on each, bandwidth
DENSITY = f"""with a as (select least(quantile_cont(l_discount, 0.005) - {PAD}, -{PAD}) as x0, greatest(quantile_cont(l_discount, 0.995) + {PAD}, {PAD}) as x1, least(quantile_cont(l_tax, 0.005) - {PAD}, -{PAD}) as y0, greatest(quantile_cont(l_tax, 0.995) + {PAD}, {PAD}) as y1 from lineitem),
p as (select l_returnflag as g, l_discount as x, l_tax as y, count(*) as c from lineitem group by all),
s as (select l_returnflag as g, count(*) as n, {WIDTH}::double * {WIDTH} * var_samp(l_discount) as kx, {WIDTH}::double * {WIDTH} * covar_samp(l_discount, l_tax) as kxy, {WIDTH}::double * {WIDTH} * var_samp(l_tax) as ky from lineitem group by 1),
q as (select i, j, x0 + i * (x1 - x0) / {CELLS - 1} as gx, y0 + j * (y1 - y0) / {CELLS - 1} as gy from a, range({CELLS}) r(i), range({CELLS}) u(j))
select g as l_returnflag, i, j, sum(c * exp(-0.5 * (ky * power(gx - x, 2) - 2 * kxy * (gx - x) * (gy - y) + kx * power(gy - y, 2)) / (kx * ky - kxy * kxy))) / any_value(n * 2 * pi() * sqrt(kx * ky - kxy * kxy)) as density from q, p join s using (g) group by all"""


@query("fig10_kernel_density", DENSITY)
def _(t):
    """Two-dimensional density of each group on a grid over the inner 99 percent of both axes; SQL sums over the points themselves."""
    axes = []
    for c in ("l_discount", "l_tax"):
        low, high = Q.exact(t.lineitem, [], c, [0.005, 0.995]).first().q
        axes.append((min(low - PAD, -PAD), max(high + PAD, PAD)))
    return density.kernel_density(t.lineitem, "l_returnflag", "l_discount", "l_tax", *axes, CELLS, WIDTH)


RAW = "case when o_orderkey % 3 = 0 then null else cast(o_orderdate as timestamp) end"


def raw_dates(t):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.lit("not a date")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return t.orders.select("o_orderkey", raw.alias("raw"))


@query("prj02_dated_rows", f"select o_orderkey, {RAW} as ts from orders where o_orderkey % 3 <> 0")
def _(t):
    return files.dated(raw_dates(t), "raw", "ts")[0].select("o_orderkey", F.col("ts").cast("timestamp_ntz").alias("ts"))


COUNTS = "select 'dates' as source, count(*) as n_read, count_if(o_orderkey % 3 = 0) as n_bad, count_if(o_orderkey % 3 <> 0) as n_kept from orders union all select 'tsv', count(*), count_if(l_orderkey % 4 = 3), count_if(l_orderkey % 4 <> 3) from lineitem union all select 'jsonl', count(*), count_if(event_id % 7 = 0), count_if(event_id % 7 <> 0) from events"


@query("prj02_src01_src05_drop_counts", COUNTS, longs="n_read n_bad n_kept")
def _(t):
    """Rows read, dropped and kept by three loads, counted in the scan that loads."""
    tsv, jsonl = files.scratch(t.spark, "tsv"), files.scratch(t.spark, "jsonl")
    k = F.col("l_orderkey")
    t.lineitem.select(F.concat_ws("\t", k, "l_linenumber", F.when(k % 4 == 3, F.lit("one\tmore")).when(k % 4 == 2, F.lit(None)).otherwise(F.lit('"a ""quoted"" field"'))).alias("value")).write.text(tsv)
    whole = F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(F.col("event_id") % 14 == 0, F.substring(whole, 1, 12)).when(F.col("event_id") % 7 == 0, F.lit("not json")).otherwise(whole).alias("value")).write.text(jsonl)
    loads = {"dates": (files.dated(raw_dates(t), "raw", "ts"), "undated"), "tsv": (files.read_tsv_counted(t.spark, tsv, ["a", "b", "c"], header=False), "long"), "jsonl": (files.read_jsonl_counted(t.spark, jsonl, "event_id long, event_type string"), "corrupt")}
    return t.spark.createDataFrame([(name, c["read"], c[bad], rows.count()) for name, ((rows, c), bad) in loads.items()], "source string, n_read long, n_bad long, n_kept long")


@query("ded03_snk04_stream_state", "select user_id, event_id, event_type, value, ts from (select *, row_number() over (partition by user_id order by event_type <> 'error' desc, event_id desc) as rn from events) where rn = 1")
def _(t):
    """Latest success wins, as state of a stream that reads all events in six triggers, each of a file a core."""
    cores = t.spark.sparkContext.defaultParallelism
    source, out, checkpoint = (files.scratch(t.spark, n) for n in ("events", "changes", "checkpoint"))
    t.events.repartitionByRange(6 * cores, "event_id").write.parquet(source)
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", cores).parquet(source)
    stream = stream.select("user_id", "event_id", "event_type", "value", "ts", F.when(F.col("event_type") == "error", "error").alias("failure"))
    jobs.append_changes(jobs.winners(stream, "user_id", "failure", "event_id"), out, checkpoint).awaitTermination()
    return jobs.latest(t.spark, out, "user_id").drop("failure")


def lines_of(t, path):
    """n, line of a text file."""
    return t.spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))


REPORT = r"with s as (select '# Items' || chr(10) || string_agg('### ' || item_id || chr(10) || chr(10) || '> ' || regexp_replace(text, '\s+', ' ', 'g') || chr(10), chr(10) order by item_id) || chr(10) as v from benchmark) select cast(i - 1 as int) as n, string_split(v, chr(10))[i] as line from (select v, unnest(range(1, len(string_split(v, chr(10))) + 1)) as i from s)"


@query("snk05_report_file", REPORT)
def _(t):
    path = files.scratch(t.spark, "report")
    report.write_report(t.benchmark.select("item_id", files.markdown(t.benchmark, "item_id", "text").alias("md")), "md", ["item_id"], f"{path}/items.md", head="# Items\n")
    return lines_of(t, f"{path}/items.md")


MACROS = "with m as (select '\\newcommand{\\nOrders' || c_custkey || '}{' || format('{:,}', count(o_orderkey)) || '}' as line, c_custkey from customer left join orders on o_custkey = c_custkey group by c_custkey) select cast(row_number() over (order by c_custkey) - 1 as int) as n, line from m union all select cast(count(*) as int), '' from m"


@query("snk06_macro_file", MACROS)
def _(t):
    path = files.scratch(t.spark, "macros")
    n = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    report.write_report(n.select("c_custkey", files.latex_macro(F.concat(F.lit("nOrders"), F.col("c_custkey").cast("string")), F.col("n").cast("double")).alias("macro")), "macro", ["c_custkey"], f"{path}/macros.tex")
    return lines_of(t, f"{path}/macros.tex")


def bucket_sql() -> str:
    parts = []
    for j in range(10):
        earlier = " union all ".join(f"select o_orderkey from b{i}" for i in range(j)) or "select -1"
        parts.append(f"b{j} as (select o_orderkey, 'b{j}' as bucket from orders where o_orderkey % {j + 2} = 0 and o_orderkey not in ({earlier}) order by sha256('42:' || o_orderkey), o_orderkey limit {20 + 5 * j})")
    return f"with {', '.join(parts)} " + " union all ".join(f"select * from b{j}" for j in range(10))


@query("smp05_smp06_ten_buckets", bucket_sql())
def _(t):
    """Ten overlapping rules, one scan."""
    return P.buckets(t.orders.select("o_orderkey"), "o_orderkey", [(f"b{j}", F.col("o_orderkey") % (j + 2) == 0, 20 + 5 * j) for j in range(10)]).select("o_orderkey", "bucket")


@query("view_regions", "select case when contains(source, 'src1') then 'north' when contains(source, 'src2') then 'south' when contains(source, 'src3') then 'west' when contains(source, 'src') then 'elsewhere' end as region, count(*) as n, count_if(length(trim(text)) > 500) as n_long from documents where length(trim(text)) > 0 group by 1", longs="n_long")
def _(t):
    views.register(t.spark, t.documents, t.labels)
    return t.spark.sql("select region_of(source) as region, count(*) as n, count_if(length(body) > 500) as n_long from stage_clean group by 1")


@query("view_wilson", "with c as (select source, count_if(quality = 1) as k, count(*) as n from documents join labels using (doc_id) where length(trim(text)) > 0 group by source), z as (select *, 1.959963984540054::double as z from c) select source, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n) as low, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n) as high from z", doubles="low high")
def _(t):
    views.register(t.spark, t.documents, t.labels)
    return t.spark.sql("select source, wilson_low(k, n) as low, wilson_high(k, n) as high from (select c.source, count_if(l.quality = 1) as k, count(*) as n from stage_clean c join stage_labels l on c.doc_id = l.doc_id group by c.source)")


@query("view_cleaned_mentions", "select doc_id, cast(len(regexp_extract_all(lower(text), '\\bthat\\b')) as bigint) as n_that, case when len(regexp_extract_all(lower(text), '\\bthat\\b')) / 10.0 >= 0.1 then 'supportive' else 'neutral' end as stance, fold as label from (select *, replace(replace(lower(source), ' ', '_'), '-', '_') as fold from documents) where length(trim(text)) > 0")
def _(t):
    views.register(t.spark, t.documents, t.labels)
    return t.spark.sql("select doc_id, mentions_that(body) as n_that, stance_bucket(mentions_that(body) / 10) as stance, fold_label(source) as label from stage_clean")
