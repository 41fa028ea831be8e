"""Queries of statistics: contrasts, ranks, contingency tables, resampling, regression and interrupted time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, tails
from ..operators import quantiles as Q
from ..operators import relational as R
from ..operators import stats as A
from .registry import query
from .table_queries import MONTH, REGION_ORDERS, region_orders

AT = "1998-06-15"

MOMENTS = "count({v}) filter ({g}) as n1, avg({v}) filter ({g}) as mean1, var_samp({v}) filter ({g}) as var1, count({v}) filter (not ({g})) as n2, avg({v}) filter (not ({g})) as mean2, var_samp({v}) filter (not ({g})) as var2"


#: Tail probabilities by Simpson's rule over u = low + s / (1 - s), for s from 0 to 1: another way than the library's.
CUTS = 4000


def upper(density: str, low: str) -> str:
    """SQL: the integral of a density (of u) from low up."""
    s = f"(i / {CUTS}.0::double)"
    each = f"({density.replace('{u}', f'({low} + {s} / (1 - {s}))')}) / power(1 - {s}, 2) * case when i = 0 then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(list_sum(list_transform(range(0, {CUTS}), lambda i: {each})) / {3 * CUTS}.0)"


def t_tail(t: str, df: str) -> str:
    return f"2 * {upper(f'exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) - ({df} + 1) / 2 * ln(1 + {{u}} * {{u}} / {df}))', f'abs({t})')}"


def normal_tail(z: str) -> str:
    return f"2 * {upper('exp(-{u} * {u} / 2) / sqrt(2 * pi())', f'abs({z})')}"


def chi2_tail(x: str, df: str) -> str:
    return upper(f"exp(({df} / 2.0 - 1) * ln({{u}}) - {{u}} / 2 - {df} / 2.0 * ln(2) - lgamma({df} / 2.0))", x)


def finished(inner: str, keep: str = "") -> str:
    return f"select {keep} n1, n2, difference, round(t, 6) as t, round(df, 4) as df, round(d, 6) as d, {t_tail('t', 'df')} as p from ({unrounded(inner, keep)})"


def unrounded(inner: str, keep: str = "") -> str:
    return f"select {keep} n1, n2, round(mean1 - mean2, 6) as difference, (mean1 - mean2) / nullif(sqrt(var1 / n1 + var2 / n2), 0) as t, power(var1 / n1 + var2 / n2, 2) / nullif(power(var1 / n1, 2) / (n1 - 1) + power(var2 / n2, 2) / (n2 - 1), 0) as df, case when (n1 - 1) * var1 + (n2 - 1) * var2 = 0 then 0 else (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)) end as d from ({inner})"


def shown(df, *keep):
    return df.select(*keep, "n1", "n2", F.round("difference", 6).alias("difference"), F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("d", 6).alias("d"), "p")


def scored(t):
    """Labelled documents with outcomes: a stand-in for scored articles."""
    return t.documents.join(t.labels, "doc_id").select("doc_id", "source", "lang", "quality", "toxic", F.col("n_chars").cast("double").alias("chars"))


SCORED = "(select doc_id, source, lang, quality, toxic, cast(n_chars as double) as chars from documents join labels using (doc_id))"


def good():
    return F.col("quality") == 1


@query("sta01_sta02_welch_cohen", finished(f"select {MOMENTS.format(v='chars', g='quality = 1')} from {SCORED}"))
def _(t):
    return shown(A.contrast(scored(t), [], "chars", good()))


@query("sta22_pre_post_contrast", finished("select o_orderpriority, " + MOMENTS.format(v="o_totalprice", g=f"o_orderdate >= date '{AT}'") + " from orders group by o_orderpriority", "o_orderpriority,"))
def _(t):
    return shown(A.contrast(t.orders, ["o_orderpriority"], "o_totalprice", F.col("o_orderdate") >= AT), "o_orderpriority")


@query("sta23_fig15_quarterly_effect", finished("select cast(date_trunc('quarter', l_shipdate) as date) as quarter, " + MOMENTS.format(v="l_extendedprice", g="l_returnflag = 'R'") + " from lineitem group by 1 having count(l_extendedprice) filter (l_returnflag = 'R') >= 15 and count(l_extendedprice) filter (not (l_returnflag = 'R')) >= 15", "quarter,"))
def _(t):
    q = t.lineitem.withColumn("quarter", F.to_date(F.date_trunc("quarter", "l_shipdate")))
    return shown(A.contrast(q, ["quarter"], "l_extendedprice", F.col("l_returnflag") == "R").where("n1 >= 15 and n2 >= 15"), "quarter")


@query("sta24_sta40_leave_one_out", "with m as (select p_brand, l_quantity as v, l_returnflag = 'R' as g from lineitem join part on l_partkey = p_partkey), b as (select distinct p_brand as without from m) " + finished("select without, " + MOMENTS.format(v="v", g="g") + " from b join m on p_brand <> without group by without", "without,"))
def _(t):
    """Moments are additive: per brand once, then totals less the brand; no scan per brand."""
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    v, g = F.col("l_quantity"), F.col("l_returnflag") == "R"
    parts = m.groupBy("p_brand").agg(*(e for k, c in (("1", g), ("2", ~g)) for e in (F.count(F.when(c, v)).alias(f"n{k}"), F.sum(F.when(c, v)).alias(f"s{k}"), F.sum(F.when(c, v * v)).alias(f"q{k}"))))
    total = parts.agg(*(F.sum(c).alias(f"t_{c}") for c in ("n1", "s1", "q1", "n2", "s2", "q2")))
    left = parts.crossJoin(F.broadcast(total)).select(F.col("p_brand").alias("without"), *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in ("n1", "s1", "q1", "n2", "s2", "q2")))  # total is one row
    moments = left.select("without", *(e for k in "12" for e in (F.col(f"n{k}"), (F.col(f"s{k}") / F.col(f"n{k}")).alias(f"mean{k}"), ((F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col(f"n{k}")) / (F.col(f"n{k}") - 1)).alias(f"var{k}"))))
    return shown(A.finish_contrast(moments), "without")


@query("sta25_weighting_variants", "select variant, round(avg(case when variant = 'equal' then (l_discount + l_tax) / 2 when variant = 'discount' then l_discount else 0.7 * l_discount + 0.3 * l_tax end), 8) as mean from lineitem, (select unnest(['equal', 'discount', 'weighted']) as variant) group by variant")
def _(t):
    variants = {"equal": {"d": 0.5, "t": 0.5}, "discount": {"d": 1.0, "t": 0.0}, "weighted": {"d": 0.7, "t": 0.3}}
    values = {"d": F.col("l_discount"), "t": F.col("l_tax")}
    means = t.lineitem.agg(*(F.avg(scalars.weighted_mean(values, w)).alias(k) for k, w in variants.items()))
    return means.unpivot([], list(variants), "variant", "mean").select("variant", F.round("mean", 8).alias("mean"))


@query("sta26_zero_inflation", "select l_returnflag, count(*) as n, avg(cast(l_discount = 0 as double)) as share_zero, avg(case when l_discount <> 0 then l_discount end) as mean_nonzero from lineitem group by l_returnflag")
def _(t):
    z = F.col("l_discount") == 0
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg(z.cast("double")).alias("share_zero"), F.avg(F.when(~z, F.col("l_discount"))).alias("mean_nonzero"))


@query("sta27_fig03_paired_contrast", finished(f"select r_name, {MOMENTS.format(v='o_totalprice', g=chr(39) + 'BUILDING' + chr(39) + ' = c_mktsegment')} from {REGION_ORDERS} where c_mktsegment in ('BUILDING', 'MACHINERY') group by r_name", "r_name,"))
def _(t):
    o = region_orders(t).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return shown(A.contrast(o, ["r_name"], "o_totalprice", F.col("c_mktsegment") == "BUILDING"), "r_name")


PRICES = MOMENTS.format(v="l_extendedprice", g="l_discount >= 0.05")


@query("sta01_sta09_contrasts_adjusted", f"with p as (select supplier, p from ({finished(f'select l_suppkey % 40 as supplier, {PRICES} from lineitem group by 1', 'supplier,')})), r as (select *, rank() over (order by p) + count(*) over (partition by p) - 1 as k, count(*) over () as m from p) select supplier, p, least(1.0, min(p * m / k) over (order by p desc)) as p_bh from r", doubles="p_bh")
def _(t):
    """Contrasts by group, their p-values and the adjusted ones, in one plan."""
    c = A.contrast(t.lineitem.withColumn("supplier", F.col("l_suppkey") % 40), ["supplier"], "l_extendedprice", F.col("l_discount") >= 0.05)
    return A.benjamini_hochberg(c.where("p is not null"), "p").select("supplier", "p", "p_bh")


SUBSETS = {"all": "true", "english": "lang = 'en'", "clean": "toxic = 0", "short": "chars < 2000"}


@query("sta28_sta29_sta30_sensitivity", " union all ".join(finished(f"select '{k}' as subset, {MOMENTS.format(v='chars', g='quality = 1')} from {SCORED} where {w}", "subset,") for k, w in SUBSETS.items()))
def _(t):
    """All subsets in one scan: conditional moments, then rows from columns."""
    v, parts = F.col("chars"), []
    for k, w in SUBSETS.items():
        for side, g in (("1", good()), ("2", ~good())):
            x = F.when(F.expr(w) & g, v)
            parts += [F.count(x).alias(f"{k}_n{side}"), F.avg(x).alias(f"{k}_mean{side}"), F.var_samp(x).alias(f"{k}_var{side}")]
    wide = scored(t).agg(*parts)
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("subset"), *(F.col(f"{k}_{c}{side}").alias(f"{c}{side}") for side in "12" for c in ("n", "mean", "var"))) for k in SUBSETS))).alias("r")).select("r.*")
    return shown(A.finish_contrast(long), "subset")


PS = "(select l_partkey % 97 as family, (l_extendedprice * 7919) % 1000 / 1000 as p, l_orderkey, l_linenumber from lineitem)"


@query("sta09_win06_bh_adjust", f"with r as (select *, row_number() over (partition by family order by p, l_orderkey, l_linenumber) as k, count(*) over (partition by family) as m from {PS}) select family, l_orderkey, l_linenumber, round(least(1.0, min(p * m / k) over (partition by family order by k rows between current row and unbounded following)), 9) as p_bh from r", doubles="p_bh")
def _(t):
    p = t.lineitem.select((F.col("l_partkey") % 97).alias("family"), "l_orderkey", "l_linenumber", ((F.col("l_extendedprice") * 7919) % 1000 / 1000).alias("p"))
    return A.benjamini_hochberg(p, "p", by=["family"]).select("family", "l_orderkey", "l_linenumber", F.round("p_bh", 9).alias("p_bh"))


RANK_SQL = "with v as (select {by} {v} as v, {g} as g from {src}), r as (select *, rank() over ({p} order by v) + (count(*) over (partition by {byp} v) - 1) / 2.0 as k from v), s as (select {by} count(*) filter (g) as n1, count(*) filter (not g) as n2, sum(k) filter (g) as r1 from r {grp}), e as (select {by} sum(power(c, 3) - c) as ties from (select {by} v, cast(count(*) as double) as c from v where v is not null and g is not null group by {by} v) {grp}), z as (select *, (greatest(abs(r1 - n1 * (n1 + 1) / 2.0 - cast(n1 as double) * n2 / 2) - 0.5, 0)) / sqrt(cast(n1 as double) * n2 / 12 * (n1 + n2 + 1 - ties / (cast(n1 + n2 as double) * (n1 + n2 - 1)))) as z from s {join} e {on}) select {by} n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 3) as u, round(2 * (r1 - n1 * (n1 + 1) / 2.0) / (cast(n1 as double) * n2) - 1, 9) as delta, round((r1 - n1 * (n1 + 1) / 2.0) / (cast(n1 as double) * n2), 9) as auc, {tail} as p from z"


@query("sta03_sta04_sta35_rank_tests", RANK_SQL.format(by="o_orderstatus,", byp="o_orderstatus,", v="o_totalprice", g="o_orderpriority < '3'", src="orders", p="partition by o_orderstatus", grp="group by o_orderstatus", join="join", on="using (o_orderstatus)", tail=normal_tail("z")), doubles="u delta auc p")
def _(t):
    return A.rank_test(t.orders, "o_totalprice", F.col("o_orderpriority") < "3", ["o_orderstatus"]).select("o_orderstatus", "n1", "n2", F.round("u", 3).alias("u"), F.round("delta", 9).alias("delta"), F.round("auc", 9).alias("auc"), "p")


@query("sta35_auc", RANK_SQL.format(by="", byp="", v="n_chars", g="quality = 1", src="documents join labels using (doc_id)", p="", grp="", join="cross join", on="", tail=normal_tail("z")), doubles="u delta auc p")
def _(t):
    d = t.documents.join(t.labels, "doc_id")
    return A.rank_test(d, "n_chars", good()).select("n1", "n2", F.round("u", 3).alias("u"), F.round("delta", 9).alias("delta"), F.round("auc", 9).alias("auc"), "p")


@query("sta15_spearman", "with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as x, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as y from lineitem) select l_returnflag, round(corr(x, y), 8) as rho, count(*) as n from r group by l_returnflag")
def _(t):
    return A.spearman(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("rho", 8).alias("rho"), "n")


PEARSON = "with c as (select l_returnflag, corr(l_quantity, {y}) as r, count(*) as n from lineitem group by l_returnflag having count(*) > 10) select l_returnflag, round(r, 8) as r, n, {p} as p from c"


@query("sta14_pearson_pairs", PEARSON.format(y="l_extendedprice", p=t_tail("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")))
def _(t):
    return A.pearson(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("r", 8).alias("r"), "n", "p")


@query("sta14_pearson_unrelated", PEARSON.format(y="l_discount", p=t_tail("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")))
def _(t):
    return A.pearson(t.lineitem, "l_quantity", "l_discount", ["l_returnflag"]).select("l_returnflag", F.round("r", 8).alias("r"), "n", "p")


@query("sta10_sta12_chi2_cramers", "with c as (select source, lang, count(*) as n from documents group by all), r as (select source, sum(n) as r from c group by 1), k as (select lang, sum(n) as k from c group by 1), s as (select sum(n * n / cast(r as double) / k) as s, count(distinct source) as nr, count(distinct lang) as nc, sum(n) as t from c join r using (source) join k using (lang)) select round(t * (s - 1), 6) as chi2, (nr - 1) * (nc - 1) as dof, " + chi2_tail("(t * (s - 1))", "((nr - 1) * (nc - 1))") + " as p, round(sqrt((s - 1) / (least(nr, nc) - 1)), 8) as cramers_v, t as n from s", longs="n", doubles="chi2 p")
def _(t):
    c = A.chi2(t.documents.groupBy("source", "lang").agg(F.count("*").alias("n")), "source", "lang")
    return c.select(F.round("chi2", 6).alias("chi2"), "dof", "p", F.round("cramers_v", 8).alias("cramers_v"), "n")


@query("sta11_fig12_yates_risk_ratio", "with c as (select count_if(quality = 1 and toxic = 1) as n11, count_if(quality = 1 and toxic = 0) as n10, count_if(quality = 0 and toxic = 1) as n01, count_if(quality = 0 and toxic = 0) as n00 from labels), x as (select *, cast(n11 + n10 + n01 + n00 as double) as n, n * power(greatest(abs(cast(n11 as double) * n00 - cast(n10 as double) * n01) - n / 2, 0), 2) / (cast(n11 + n10 as double) * (n01 + n00) * (n11 + n01) * (n10 + n00)) as x from c) select n11, n10, n01, n00, round(x, 8) as chi2, " + normal_tail("sqrt(x)") + " as p, round((n11 / (n11 + n01)) / (n10 / (n10 + n00)), 8) as risk_ratio from x", longs="n11 n10 n01 n00")
def _(t):
    return A.two_by_two(t.labels, F.col("quality") == 1, F.col("toxic") == 1, []).select("n11", "n10", "n01", "n00", F.round("chi2", 8).alias("chi2"), "p", F.round("risk_ratio", 8).alias("risk_ratio"))


FISHER = """with c as (select count_if(quality = 1 and toxic = 1) as a, count_if(quality = 1 and toxic = 0) as b, count_if(quality = 0 and toxic = 1) as c, count_if(quality = 0 and toxic = 0) as d from labels),
x as (select *, a + b as r, c + d as s, a + c as k, a + b + c + d as n from c),
h as (select a, b, c, d, unnest(range(cast(greatest(0, k - s) as bigint), cast(least(k, r) as bigint) + 1)) as i, r, s, k, n from x),
l as (select *, lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(s + 1) - lgamma(k - i + 1) - lgamma(s - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1) as lp from h)
select cast(any_value(a) as double) * any_value(d) / (cast(any_value(b) as double) * any_value(c)) as odds, least(1.0, sum(exp(lp)) filter (lp <= (select lp from l where i = a) + 1e-7)) as p from l"""


@query("sta13_fisher_exact", FISHER, doubles="odds p")
def _(t):
    c = A.two_by_two(t.labels, F.col("quality") == 1, F.col("toxic") == 1, []).first()
    odds, p = tails.fisher_exact(c.n11, c.n10, c.n01, c.n00)
    return t.spark.createDataFrame([(float(odds), float(p))], "odds double, p double")


CODED = "(select o_orderkey, o_orderstatus as a, case when o_orderkey % 4 = 0 then 'F' else o_orderstatus end as b, o_orderpriority as k from orders)"


@query("sta31_sta34_kappa", f"with c as (select k, a, b, count(*) as c from {CODED} group by all), n as (select k, sum(c) as n, sum(case when a = b then c else 0 end) as agree from c group by k), p as (select x.k, sum(cast(x.n as double) * y.n) as chance from (select k, a, sum(c) as n from c group by all) x join (select k, b, sum(c) as n from c group by all) y on x.k = y.k and x.a = y.b group by x.k) select k, n, agree / n as agreement, round((agree / n - chance / n / n) / (1 - chance / n / n), 9) as kappa from n join p using (k)", longs="n")
def _(t):
    o = t.orders.select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("b"), F.col("o_orderpriority").alias("k"))
    return A.kappa(o, "a", "b", by=["k"]).select("k", "n", "agreement", F.round("kappa", 9).alias("kappa"))


@query("sta31_kappa_fixed_labels", f"with x as (select * from {CODED} where a in ('F', 'O') and b in ('F', 'O')), m as (select count(*) as n, count_if(a = b) as agree, cast(count_if(a = 'F') as double) * count_if(b = 'F') + cast(count_if(a = 'O') as double) * count_if(b = 'O') as chance from x) select n, round((agree / n - chance / n / n) / (1 - chance / n / n), 9) as kappa from m")
def _(t):
    o = t.orders.select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("b"))
    return A.kappa(o, "a", "b", ["F", "O"]).select("n", F.round("kappa", 9).alias("kappa"))


WILSON = "case when n > 0 then round({f}({b}, (k / n + z * z / (2 * n) {s} z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) end"


@query("sta36_sta38_wilson", f"with c as (select source, count_if(quality = 1) as k, count(quality) as n, 1.959963984540054::double as z from documents left join labels using (doc_id) group by source) select source, k, n, {WILSON.format(f='greatest', b='0.0', s='-')} as low, {WILSON.format(f='least', b='1.0', s='+')} as high from c", longs="k", doubles="low high")
def _(t):
    c = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count_if(good()).alias("k"), F.count("quality").alias("n"))
    low, high = scalars.wilson(F.col("k"), F.col("n"))
    return c.select("source", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("sta37_threshold_recall", "select t as threshold, count_if(quality = 1 and n_chars >= t) / count_if(quality = 1) as recall, count_if(quality = 1 and n_chars >= t) / nullif(count_if(n_chars >= t), 0) as precision from documents join labels using (doc_id), (select unnest([200, 1000, 3000]) as t) group by t")
def _(t):
    d = t.documents.join(t.labels, "doc_id")
    one = [F.struct(F.lit(k).alias("threshold"), (F.count_if(good() & (F.col("n_chars") >= k)) / F.count_if(good())).alias("recall"), F.try_divide(F.count_if(good() & (F.col("n_chars") >= k)), F.count_if(F.col("n_chars") >= k)).alias("precision")) for k in (200, 1000, 3000)]
    return d.agg(F.array(*one).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query("mth02_cohen_h", "select round(2 * asin(sqrt(avg(toxic) filter (quality = 1))) - 2 * asin(sqrt(avg(toxic) filter (quality = 0))), 9) as h from labels")
def _(t):
    p = t.labels.agg(F.avg(F.when(good(), F.col("toxic"))).alias("a"), F.avg(F.when(~good(), F.col("toxic"))).alias("b"))
    return p.select(F.round(scalars.cohen_h(F.col("a"), F.col("b")), 9).alias("h"))


def t_above(t: str, df: str) -> str:
    return upper(f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) - ({df} + 1) / 2 * ln(1 + {{u}} * {{u}} / {df}))", t)


TOST = f"""with m as (select {MOMENTS.format(v='chars', g='quality = 1')} from {SCORED}), q as (select *, ((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) as pooled, var1 / n1 + var2 / n2 as ab, mean1 - mean2 as diff from m),
w as (select false as welch, sqrt(pooled * (1 / n1 + 1 / n2)) as se, cast(n1 + n2 - 2 as double) as df, diff, 0.2::double * sqrt(pooled) as bound from q union all select true, sqrt(ab), ab * ab / (power(var1 / n1, 2) / (n1 - 1) + power(var2 / n2, 2) / (n2 - 1)), diff, 0.2::double * sqrt(pooled) from q),
p as (select welch, diff, bound, greatest({t_above('((diff + bound) / se)', 'df')}, {t_above('((bound - diff) / se)', 'df')}) as p from w)
select welch, diff as difference, bound, p, p < 0.05 as equivalent from p"""


@query("sta07_sta08_tost", TOST, doubles="difference bound p")
def _(t):
    m = A.contrast(scored(t), [], "chars", good()).first()
    rows = [(w, *A.tost(m.n1, m.mean1, m.var1, m.n2, m.mean2, m.var2, welch=w).values()) for w in (False, True)]
    return t.spark.createDataFrame(rows, "welch boolean, difference double, bound double, p double, equivalent boolean")


@query("sta05_bootstrap_contrast")
def _(t):
    return A.bootstrap_contrast(scored(t), "chars", good(), "doc_id", 10_000)


@query("sta05_bootstrap_by_group")
def _(t):
    return A.bootstrap_means(scored(t), ["source"], "chars", "doc_id", 1000).drop("n")


@query("fig02_fig06_bootstrap_intervals")
def _(t):
    """Intervals of the mean by entity, of entities with at least five documents."""
    return A.bootstrap_means(t.documents, ["source"], "n_chars", "doc_id", 5000, least=5)


@query("sta32_kappa_interval")
def _(t):
    o = t.orders.select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("b"))
    return t.spark.createDataFrame([tuple(A.kappa_ci(o, "a", "b", ["F", "O", "P"]).values())], "n long, kappa double, low double, high double")


@query("sta33_proportion_interval")
def _(t):
    rows = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count_if(good()).alias("k"), F.count("*").alias("n")).collect()  # a row a language
    return t.spark.createDataFrame([(r.lang, r.k / r.n, *A.proportion_ci(r.k, r.n)) for r in rows], "lang string, share double, low double, high double")


PAIRED = "(select a.o_orderkey as packet, a.o_orderpriority as p_a, case when a.o_orderkey % 7 = 0 then '' when a.o_orderkey % 3 = 0 then '1-URGENT' else a.o_orderpriority end as p_b, a.o_orderstatus as s_a, case when a.o_orderkey % 5 = 0 then ' P ' else a.o_orderstatus end as s_b from orders a)"
LONG_PAIRS = f"(select packet, 'p' as field, trim(p_a) as value_a, trim(p_b) as value_b from {PAIRED} union all select packet, 's', trim(s_a), trim(s_b) from {PAIRED})"


def paired(t):
    """Two coders' labels of the same packets: the second leaves some blank, and differs in some."""
    k = F.col("o_orderkey")
    one = t.orders.select(k.alias("packet"), F.lit("ann").alias("coder"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    two = t.orders.select(k.alias("packet"), F.lit("ben").alias("coder"), F.when(k % 7 == 0, "").when(k % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("p"), F.when(k % 5 == 0, " P ").otherwise(F.col("o_orderstatus")).alias("s"))
    pairs = R.coder_pairs(one.unionByName(two).withColumn("x", F.struct("p", "s")), "packet", "coder", "x")
    return pairs.select("packet", "coder_a", "coder_b", *(F.col(f"label_{k}.{f}").alias(f"{f}_{k}") for f in "ps" for k in "ab"))


@query("sta39_agreement", f"select 'ann' as coder_a, 'ben' as coder_b, field, count(*) as n, count_if(value_a = value_b) as n_equal, count_if(value_a = value_b) / count(*) as share from {LONG_PAIRS} where value_a <> '' and value_b <> '' group by field", longs="n_equal")
def _(t):
    return A.agreement(paired(t), ["p", "s"])[0]


@query("sta39_disagreements", f"select packet, 'ann' as coder_a, 'ben' as coder_b, field, value_a, value_b from {LONG_PAIRS} where value_a <> '' and value_b <> '' and value_a <> value_b")
def _(t):
    return A.agreement(paired(t), ["p", "s"])[1]


@query("sta06_cluster_bootstrap")
def _(t):
    return t.spark.createDataFrame([A.cluster_bootstrap(scored(t), "source", "chars", good())], "difference double, low double, high double, p double, n_clusters long")


def designed(t):
    return A.its_design(A.monthly(t.orders, "o_orderdate", "o_totalprice"), AT)


DESIGN = f"(with m as (select {MONTH} as month, avg(o_totalprice) as mean, count(*) as n from orders group by 1), o as (select *, year(month) * 12 + month(month) - 1 as k from m) select month, mean, n, k - min(k) over () as time, cast(k >= 1998 * 12 + 5 as bigint) as post, greatest(k - (1998 * 12 + 5), 0) as time_after from o)"


@query("sta17_its_design", f"select * from {DESIGN}")
def _(t):
    return designed(t)


@query("sta17_its_normal_equations", f"select round(sum(n), 3) as s00, round(sum(n * time), 3) as s01, round(sum(n * post), 3) as s02, round(sum(n * time_after), 3) as s03, round(sum(n * mean) / 1e6, 6) as b0, round(sum(n * time * mean) / 1e6, 5) as b1 from {DESIGN}", doubles="s00 s01 s02 s03 b0 b1")
def _(t):
    d = designed(t)
    n = F.col("n").cast("double")
    return d.agg(F.round(F.sum(n), 3).alias("s00"), F.round(F.sum(n * F.col("time")), 3).alias("s01"), F.round(F.sum(n * F.col("post")), 3).alias("s02"), F.round(F.sum(n * F.col("time_after")), 3).alias("s03"), F.round(F.sum(n * F.col("mean")) / 1e6, 6).alias("b0"), F.round(F.sum(n * F.col("time") * F.col("mean")) / 1e6, 5).alias("b1"))


@query("sta17_sta18_sta20_its_hac")
def _(t):
    rows = designed(t).collect()  # a row a month
    out = [{"lag_rule": str(lag or "automatic"), **{k: v for k, v in A.segmented(rows, lag).items() if k not in ("status", "n_pre", "n_post")}} for lag in (3, 6, None)]
    return t.spark.createDataFrame([tuple(r.values()) for r in out], list(out[0]))


TERMS = ("const", "time", "post", "time_after")


def alone(term: str) -> str:
    """SQL: month, n, y and r, the regressor less its weighted fit on the others, one after the other."""
    left, source = [t for t in TERMS if t != term], f"(select month, n, mean as y, cast(1 as double) as const, cast(time as double) as time, cast(post as double) as post, cast(time_after as double) as time_after from {DESIGN})"
    while left:
        x = left.pop(0)
        rest = ", ".join(f"{c} - {x} * (sum(n * {c} * {x}) over ()) / (sum(n * {x} * {x}) over ()) as {c}" for c in [*left, term])
        source = f"(select month, n, y, {rest} from {source})"
    return f"select '{term}' as term, month, n, y, {term} as r from {source}"


#: Each coefficient and its Newey-West error (three lags) from its regressor's own part; the horizon's effect adds two of them.
HAC = f"""with r as ({' union all '.join(alone(t) for t in TERMS)}), s as (select term, sum(n * r * y) / sum(n * r * r) as b, sum(n * r * r) as s from r group by term),
w as (select max(b) filter (term = 'const') as c, max(b) filter (term = 'time') as t, max(b) filter (term = 'post') as p, max(b) filter (term = 'time_after') as a from s),
e as (select month, row_number() over (order by month) as k, mean - c - t * time - p * post - a * time_after as e, count(*) over () - 4 as df, least(12, sum(post) over () - 1) as h from {DESIGN}, w),
u as (select term, k, n * r * e / s as u, b, df, h from r join s using (term) join e using (month)),
v as (select * from u union all select 'at_horizon', k, sum(case when term = 'post' then u else h * u end), sum(case when term = 'post' then b else h * b end), any_value(df), any_value(h) from u where term in ('post', 'time_after') group by k),
z as (select x.term, any_value(x.b) as coef, any_value(x.df) as df, sqrt(sum(x.u * y.u * case when x.k = y.k then 1 else (1 - abs(x.k - y.k) / 4.0::double) end)) as se from v x join v y on x.term = y.term and abs(x.k - y.k) <= 3 group by x.term)
select term, coef, se, {t_tail('(coef / se)', 'cast(df as double)')} as p from z"""


@query("sta17_sta18_hac_errors", HAC, doubles="coef se p")
def _(t):
    fit = A.segmented(designed(t).collect())  # a row a month
    rows = [(k, fit["effect_at_horizon" if k == "at_horizon" else k], fit[f"se_{k}"], fit[f"p_{k}"]) for k in [*TERMS, "at_horizon"]]
    return t.spark.createDataFrame(rows, "term string, coef double, se double, p double")


@query("sta19_glsar")
def _(t):
    fit = A.glsar(designed(t).collect())  # a row a month
    return t.spark.createDataFrame([tuple(fit.values())], list(fit))


@query("sta20_durbin_watson", f"with d as (select month, mean - avg(mean) over () as e from {DESIGN}), l as (select e, e - lag(e) over (order by month) as step from d) select round(sum(step * step) / sum(e * e), 8) as dw from l")
def _(t):
    from pyspark.sql import Window

    s = A.monthly(t.orders, "o_orderdate", "o_totalprice")
    e = s.crossJoin(F.broadcast(s.agg(F.avg("mean").alias("m")))).select("month", (F.col("mean") - F.col("m")).alias("e"))  # one row
    step = F.col("e") - F.lag("e").over(Window.orderBy("month"))  # a row a month
    return e.withColumn("step", step).agg(F.round(F.sum(F.col("step") * F.col("step")) / F.sum(F.col("e") * F.col("e")), 8).alias("dw"))


def clustered(t):
    o = region_orders(t).select("n_name", "o_totalprice", F.lit(1.0).alias("const"), (F.col("o_orderpriority") < "3").cast("double").alias("urgent"), (F.col("o_orderdate") >= AT).cast("double").alias("post"))
    return t.spark.createDataFrame(A.ols_clustered(o, "o_totalprice", ["const", "urgent", "post"], "n_name"), "term string, coef double, se double, p double, low double, high double")


@query("sta16_fig11_ols_clustered")
def _(t):
    return clustered(t)


#: Each regressor less its fit on the others (r) gives its coefficient, and with the residuals its clustered error.
CLUSTERED = f"""with o as (select n_name as g, o_totalprice as y, cast(o_orderpriority < '3' as double) as u, cast(o_orderdate >= date '{AT}' as double) as p from {REGION_ORDERS}),
m as (select *, u - avg(u) over () as u1, p - avg(p) over () as p1, 1 - u * (sum(u) over ()) / (sum(u * u) over ()) as a, p - u * (sum(u * p) over ()) / (sum(u * u) over ()) as q from o),
r as (select g, y, u, p, u1 - p1 * (sum(u1 * p1) over ()) / (sum(p1 * p1) over ()) as ru, p1 - u1 * (sum(u1 * p1) over ()) / (sum(u1 * u1) over ()) as rp, a - q * (sum(a * q) over ()) / (sum(q * q) over ()) as rc from m),
b as (select sum(rc * y) / sum(rc * rc) as bc, sum(ru * y) / sum(ru * ru) as bu, sum(rp * y) / sum(rp * rp) as bp, sum(rc * rc) as sc, sum(ru * ru) as su, sum(rp * rp) as sp, count(*) as n from r),
e as (select g, sum(rc * x) as ec, sum(ru * x) as eu, sum(rp * x) as ep from (select r.*, y - bc - bu * u - bp * p as x from r, b) group by g),
v as (select sum(ec * ec) as vc, sum(eu * eu) as vu, sum(ep * ep) as vp, count(*) as k from e),
w as (select unnest(['const', 'urgent', 'post']) as term, unnest([bc, bu, bp]) as coef, unnest([sqrt(vc) / sc, sqrt(vu) / su, sqrt(vp) / sp]) * sqrt(k / (k - 1) * (n - 1) / (n - 3)) as se from b, v)
select term, coef, se, coef - 1.959963984540054 * se as low, coef + 1.959963984540054 * se as high from w"""


@query("sta16_clustered_errors", CLUSTERED, doubles="coef se low high")
def _(t):
    return clustered(t).drop("p")


@query("sta16_ols_coefficients", f"with o as (select o_totalprice as y, cast(o_orderdate >= date '{AT}' as double) as x from orders) select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept from o")
def _(t):
    import numpy as np

    o = t.orders.select(F.col("o_totalprice"), F.lit(1.0).alias("const"), (F.col("o_orderdate") >= AT).cast("double").alias("post"))
    xtx, xty, _, _ = A.normal_equations(o, "o_totalprice", ["const", "post"])
    b = np.linalg.solve(xtx, xty)
    return t.spark.createDataFrame([(round(float(b[1]), 6), round(float(b[0]), 6))], "slope double, intercept double")


#: With one factor, slopes are those of values less their level's means, and a level's effect is the difference of means that slopes leave.
FACTOR_OLS = f"""with o as (select n_name as f, o_totalprice as y, cast(o_orderpriority < '3' as double) as x from {REGION_ORDERS}),
l as (select f, count(*) as n, avg(x) as mx, avg(y) as my from o group by f),
w as (select sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) as b, sum((x - mx) * (x - mx)) as sxx, count(*) as n from o join l using (f)),
z as (select l.*, my - b * mx as a, first_value(my - b * mx) over (order by f) as a0, first_value(l.n) over (order by f) as n0, first_value(mx) over (order by f) as mx0, row_number() over (order by f) as k from l, w),
e as (select sum(power(y - z.a - b * x, 2)) as ssr, sum(power(y - (select avg(y) from o), 2)) as sst from o join z using (f), w),
v as (select ssr / (w.n - 1 - (select count(*) from l)) as s2, 1 - ssr / sst as r2, w.n - 1 - (select count(*) from l) as df from e, w),
t as (select 'urgent' as term, b as coef, sqrt(s2 / sxx) as se from w, v union all select 'const', a, sqrt(s2 * (1 / z.n + mx * mx / sxx)) from z, w, v where k = 1 union all select 'n_name[' || f || ']', a - a0, sqrt(s2 * (1 / z.n + 1 / n0 + power(mx - mx0, 2) / sxx)) from z, w, v where k > 1)
select term, coef, se, coef / se as t, w.n as n, r2, """ + t_tail("(coef / se)", "df") + " as p from t, v, w"


@query("sta16_fig11_factor_ols", FACTOR_OLS, doubles="coef se t r2 p")
def _(t):
    """A numeric regressor and a factor of 25 levels."""
    o = region_orders(t).select("n_name", "o_totalprice", (F.col("o_orderpriority") < "3").cast("double").alias("urgent"))
    fit = A.ols_factors(o, "o_totalprice", ["urgent"], ["n_name"])
    return t.spark.createDataFrame([tuple(r[c] for c in ("term", "coef", "se", "t", "n", "r2", "p")) for r in fit], "term string, coef double, se double, t double, n long, r2 double, p double")


@query("sta16_fig11_two_factors_clustered")
def _(t):
    """Factors of nation and year, errors robust to clusters of market segment and nation."""
    o = region_orders(t).select("n_name", "o_totalprice", (F.col("o_orderpriority") < "3").cast("double").alias("urgent"), F.year("o_orderdate").alias("year"), F.concat_ws("-", "c_mktsegment", "n_name").alias("g"))
    fit = A.ols_factors(o, "o_totalprice", ["urgent"], ["n_name", "year"], "g")
    return t.spark.createDataFrame([tuple(r.values()) for r in fit], "term string, coef double, se double, t double, p double, low double, high double, n long, r2 double")


@query("fig01_quartiles_histogram", "select lang, quantile_cont(n_chars, 0.25) as q1, quantile_cont(n_chars, 0.5) as q2, quantile_cont(n_chars, 0.75) as q3, count_if(n_chars < 1000) as b0, count_if(n_chars between 1000 and 2999) as b1, count_if(n_chars >= 3000) as b2 from documents group by lang", longs="b0 b1 b2")
def _(t):
    n = F.col("n_chars")
    bars = t.documents.groupBy("lang").agg(F.count_if(n < 1000).alias("b0"), F.count_if(n.between(1000, 2999)).alias("b1"), F.count_if(n >= 3000).alias("b2"))
    q = Q.joined(bars, Q.exact(t.documents, ["lang"], "n_chars", [0.25, 0.5, 0.75]), ["lang"])
    return q.select("lang", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "b0", "b1", "b2")


@query("fig07_agg11_prevalence_difference", "select kind, round(avg(v) filter (quality = 1) - avg(v) filter (quality = 0), 9) as difference from (select quality, unnest(['toxic', 'long', 'table']) as kind, unnest([cast(toxic as double), cast(n_chars > 3000 as double), cast(contains(text, '|') as double)]) as v from documents join labels using (doc_id)) group by kind")
def _(t):
    d = t.documents.join(t.labels, "doc_id").select("quality", F.col("toxic").cast("double").alias("toxic"), (F.col("n_chars") > 3000).cast("double").alias("long"), F.contains("text", F.lit("|")).cast("double").alias("table"))
    diff = d.agg(*((F.avg(F.when(good(), F.col(c))) - F.avg(F.when(~good(), F.col(c)))).alias(c) for c in ("toxic", "long", "table")))
    return diff.unpivot([], ["toxic", "long", "table"], "kind", "v").select("kind", F.round("v", 9).alias("difference"))


def less(v: str, x: str, keep: str, source: str) -> str:
    """SQL: source with the columns v less their weighted fit on x."""
    return f"select month, mean, n, {keep}, " + ", ".join(f"{c} - {x} * (sum(n * {c} * {x}) over ()) / (sum(n * {x} * {x}) over ()) as {c}" for c in v.split()) + f" from ({source})"


FITTED = f"select month, mean, n, " + ", ".join(f"{c} - (sum(n * {c}) over ()) / (sum(n) over ()) as {a}" for c, a in (("time", "x1"), ("post", "x2"), ("time_after", "x3"), ("mean", "y"))) + f" from {DESIGN}"
FITTED = less("x2 x3 y", "x1", "x1", FITTED)
FITTED = less("x3 y", "x2", "x2", FITTED)
FITTED = less("y", "x3", "x3", FITTED)


@query("fig18_its_fitted", f"select month, mean, mean - y as fitted from ({FITTED})")
def _(t):
    d = designed(t)
    fit = A.segmented(d.collect())  # a row a month
    return d.select("month", "mean", (F.lit(fit["const"]) + F.col("time") * fit["time"] + F.col("post") * fit["post"] + F.col("time_after") * fit["time_after"]).alias("fitted"))


def composite_documents(t):
    """Composite score of labelled documents: what the engine does end to end, in one plan."""
    from ..config import DEFAULT as C
    from ..functions import text
    from ..operators import scoring as S

    flags = S.theme_flags(F.col("text"), C)
    d = t.documents.join(t.labels, "doc_id").withColumns({"keywords": S.keyword_component(flags), "aspect": F.when(text.mentions(F.col("text"), ["that"]) > 0, -text.frame_fraction(F.col("text"), dict(C.frames)["technical"])), "document": text.frame_fraction(F.col("text"), dict(C.frames)["narrative"])})
    score, negative = S.composite({k: F.col(k) if k in ("keywords", "aspect", "document") else F.lit(None).cast("double") for k in C.weights}, C)
    return d.select("doc_id", "quality", score.alias("composite"), negative.alias("n_negative"))
