"""DuckDB equivalents of queries that SQL can express whole."""

from __future__ import annotations

from . import licenses, secrets, sharding
from .common import LOWER, UPPER

LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: str, between: str) -> str:
    return f"list_filter(string_split_regex({text}, '{between}'), lambda x: x <> '')"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


JACCARD = f"""with recursive w as (select doc_id, {words(LOW, SPACE)} as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r(doc_id, c) as (select doc_id, doc_id from documents union select e.y, r.c from r join e on e.x = r.doc_id)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.c) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id"""

WARC = """with p as (select page_id, coalesce(html, '') as h from pages), q as (select page_id, cast(strlen(h) as bigint) as n, sha256(h) as d from p),
f as (select d, min(page_id) as first from q where n >= 100 and page_id is not null group by d)
select page_id, n as payload_bytes, q.d as payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to from q left join f on f.d = q.d and n >= 100"""


def spans(rule: secrets.Rule, order: int) -> str:
    """doc_id, s, ord, e, kind of a rule's matches: pieces between matches and matches add up to offsets."""
    p = quoted(rule.pattern)
    lists = f"select doc_id, string_split_regex(coalesce(text, ''), '{p}') as q, regexp_extract_all(coalesce(text, ''), '{p}') as m, regexp_extract_all(coalesce(text, ''), '{p}', {rule.group}) as g from documents"
    each = f"select doc_id, cast(coalesce(list_sum(list_transform(q[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as bigint) as s, length(m[k]) as n, length(g[k]) as tested from (select *, unnest(range(1, len(m) + 1)) as k from ({lists}))"
    return f"select doc_id, s, {order} as ord, s + n as e, '{rule.kind}' as kind from ({each}) where tested >= {rule.shortest}"


def secrets_sql() -> str:
    found = " union all ".join(spans(r, k) for k, r in enumerate(secrets.BASE + secrets.OWN))
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, ord){}, '')"
    base = f" filter (ord < {len(secrets.BASE)})"
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)
    return f"select d.doc_id, {counts}, sha256({joined.format(base)}) as base_sha256, {joined.format('')} as spans from documents d left join ({found}) f on f.doc_id = d.doc_id group by d.doc_id"


QUALITY = f"""with t as (select doc_id, coalesce(text, '') as t, {words("coalesce(text, '')", SPACE)} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
g as (select doc_id, i, w[i:i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
c as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from r) group by doc_id),
b as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from t left join c using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b"""


def licenses_sql() -> str:
    w = words(LOW, licenses.SPLIT)
    found = " union all ".join(f"select doc_id, i - 1 as p, '{label}' as label from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w) where w[i:i + {len(phrase.split()) - 1}] = [{', '.join(repr(x) for x in phrase.split())}]" for label, phrase in licenses.BASE)
    return f"with w as (select doc_id, {w} as w from documents), f as ({found}) select w.doc_id, cast(any_value(len(w)) as bigint) as n_words, count(p) as n_base, min(p) as first_word, max(p) as last_word, coalesce(string_agg(distinct label, ',' order by label), '') as base_labels from w left join f using (doc_id) group by w.doc_id"


def crc32_sql(hexed: str) -> str:
    """CRC-32 of the bytes that the hexadecimal string shows."""
    bytes_ = f"list_transform(regexp_extract_all({hexed}, '..'), lambda x: cast('0x' || x as bigint))"
    bits = "list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(a, b))"
    return f"xor(list_reduce({bytes_}, lambda a, b: {bits}, 4294967295::bigint), 4294967295)"


def merkle_sql() -> str:
    """Trees by recursion, level by level; each node's proof and fold by walking up."""

    def leaf(n_chars: str) -> str:
        field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"

    hit = f"{crc32_sql('hex(cast(doc_id as varchar))')} % 7 = 0"
    grow = "select tree, {more} pos // 2 as pos, sha256(string_agg(h, '' order by pos)) as h, any_value(total + 1) // 2 as total, level + 1 as level from {t} where total > 1 group by tree, pos // 2, level"
    return f"""with recursive d as (select doc_id, coalesce('1' || lang, '0') as tree, {leaf('n_chars')} as leaf, case when {hit} and n_chars is not null then {leaf('n_chars + 1')} end as changed from documents),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as total from d),
t(tree, pos, h, total, level) as (select tree, pos, leaf, total, 0 from p union all {grow.format(more='', t='t')}),
s as (select tree, h as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as total from t where total = 1),
u(tree, pos, h, total, level) as (select '', pos, subroot, total, 0 from s union all {grow.format(more='', t='u')}),
r as (select h as root from u where total = 1),
b as (select tree, level, total, pos, h, max(level) over (partition by tree) as top from t),
f(doc_id, tree, pos, level, above, h, proof, leaf) as (select doc_id, tree, pos, 0, false, coalesce(changed, leaf), '', leaf from p
union all select f.doc_id, case when f.above or n.total > 1 then f.tree else f.tree end, case when n.total > 1 then f.pos // 2 else s.pos end, case when n.total > 1 then f.level + 1 else 0 end, f.above or n.total = 1, case when n.total > 1 then case when o.h is null then sha256(f.h) when f.pos % 2 = 0 then sha256(f.h || o.h) else sha256(o.h || f.h) end else f.h end, f.proof || case when n.total > 1 then coalesce(o.h, '') else '' end, f.leaf
from f join (select tree, level, pos, total, false as above from t union all select '', level, pos, total, true from u) n on n.above = f.above and n.level = f.level and n.pos = f.pos and n.tree = case when f.above then '' else f.tree end
left join (select tree, level, pos, h, false as above from t union all select '', level, pos, h, true from u) o on n.total > 1 and o.above = f.above and o.level = f.level and o.pos = xor(f.pos, 1) and o.tree = n.tree
left join s on s.tree = f.tree where not (f.above and n.total = 1))
select f.doc_id, f.leaf, s.subroot, r.root, sha256(f.proof) as proof_sha256, f.h as folded_root, f.h = r.root as verified
from f join (select tree, max(level) as level from u group by tree) m on f.above and f.level = m.level join s on s.tree = f.tree, r"""


def sharding_sql() -> str:
    def shard(n: int) -> str:
        draws = ", ".join(f"-ln((cast('0x' || substr(md5('{k}:' || coalesce(cast(doc_id as varchar), '')), 1, {sharding.DIGITS}) as bigint) + 0.5) / {16**sharding.DIGITS}.0::double)" for k in range(n))
        return f"cast(list_position([{draws}], list_min([{draws}])) - 1 as integer)"

    return f"""with d as (select doc_id, cast(coalesce(strlen(text), 0) + 1 as bigint) as size, {crc32_sql('h')} as text_crc32, {shard(sharding.SHARDS)} as shard, {shard(sharding.SHARDS + 1)} as grown_shard from (select *, hex(coalesce(text, '')) as h from documents))
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard from d"""


TRIE = f"""with t as (select conv_id, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) as t, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k from conversations where conv_id is not null),
c as (select conv_id, list(t order by turn nulls first, k) as l, {crc32_sql('hex(cast(conv_id as varchar))')} % 6 as h from t group by conv_id),
b as (select c.conv_id, list_concat(coalesce(o.l[1:c.h], []), c.l[c.h + 1:]) as l from c left join c o on o.conv_id = c.conv_id - c.conv_id % 100),
m as (select conv_id, l[1:d] as p, d, d = len(l) as ends from (select *, unnest(range(0, len(l) + 1)) as d from b)),
n as (select p, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (ends), '')) as ends_sha256 from m group by p),
k as (select p[1:depth - 1] as p, count(*) as n_children from n where depth > 0 group by 1),
a as (select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * length(n.p[depth].x) end as saved from n left join k on k.p = n.p),
s as (select u as p, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from (select n_children, saved, p[1:j] as u from (select *, unnest(range(0, depth + 1)) as j from a)) group by u)
select a.conv_id, a.depth, case when a.depth > 0 then o.conv_id end as parent_conv_id, a.n_convs, a.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, a.ends_sha256 from a join s on s.p = a.p left join a o on o.p = a.p[1:a.depth - 1] and o.depth = a.depth - 1"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": JACCARD, "op6_warc": WARC, "op8_secrets": secrets_sql(), "op11_merkle": merkle_sql(), "op12_sharding": sharding_sql(), "op13_prefix_trie": TRIE, "llm_base_quality_rules": QUALITY, "llm_base_licenses": licenses_sql()}
