import hashlib
import re

import pytest

from gleaner.llm import secrets as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def expected(rows):
    out = []
    for i, t in rows:
        b = sorted(base(t))
        own = [(m.start(), 3 + k, m.end(), r.kind) for k, r in enumerate(S.OWN) for m in re.finditer(r.pattern, t or "")]
        text = [",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in s) for s in (b, sorted(b + own))]
        out.append((i, *(sum(x[1] == k for x in b) for k in range(3)), hashlib.sha256(text[0].encode()).hexdigest(), text[1]))
    return out


def test_digests(docs, clashing, empty, rows, same):
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    want = expected(rows)
    assert sum(r[1] for r in want) and sum(r[2] for r in want) and sum(r[3] for r in want) and any("pem" in r[5] for r in want)
    same(S.digests(docs), columns, want)
    same(S.digests(clashing), columns, want)
    assert S.digests(empty).count() == 0


def test_queries_are_mandatory():
    assert S.trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert S.trigram_query("[0-9a-f]{24,}") == {frozenset()}
    assert S.trigram_query("(?:abc|xyz)d?") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert S.trigram_query("a(?:bc|)+d") == {frozenset()}
    assert frozenset({"tok", "oke", "ken"}) in S.trigram_query(S.BASE[0].pattern)
    assert all(frozenset() not in S.trigram_query(r.pattern) for r in S.OWN)


def test_many_matches_in_one_text(spark):
    text = "😀 password: abcdef\n" * 2000
    row = S.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_assign == 2000 and row.spans.split(",")[-1] == "assign:37983:37999"


def test_long_logins_and_labels(spark):
    url, pem = "https://user:" + "t" * 70 + "@", "-----BEGIN " + "VERY " * 8 + "PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, f"see {url}host and {pem} here")], "doc_id long, text string")
    found = {x.kind: x.end - x.start for x in S.scan(docs).first().spans}
    assert found["login_url"] == len(url) and found["pem"] == len(pem)


def test_clashing_names_are_refused(docs):
    with pytest.raises(ValueError, match="spans"):
        S.scan(docs, keep=("doc_id", "spans"))
