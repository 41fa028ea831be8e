import gzip
import hashlib

import pytest

from gleaner.llm import common, files, warc

LONG = "<p>" + "é" * 60


@pytest.fixture(scope="module")
def pages(spark):
    odd = [(900, "u\r\nX-Evil: 1", LONG), (901, None, LONG), (902, "v", LONG), (900, "u2", LONG), (903, "w", "short"), (904, "w", "short"), (905, "w", None), (906, "w", ""), (None, "n", LONG), (907, "big", "x" * 3_000_000)]
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    return given + odd


def expected(pages):
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        to = first[h] if i is not None and len(b) >= 100 and i > first[h] else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return out


def test_digests(spark, pages, same):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same(warc.digests(df.repartition(3)), columns, expected(pages))
    same(warc.digests(df.selectExpr("*", "1 as digest", "2 as payload", "'x' as first_id")), columns, expected(pages))
    assert warc.digests(df.limit(0)).count() == 0


def test_members_and_damage(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    whole = warc.write(warc.roles(df, 100), common.fresh_path(spark, "w"))
    member = warc.normalise(whole).collect()[0].uri
    uri = whole.collect()[0].uri
    with files.open_in(uri) as a, files.open_in(member) as b:
        assert gzip.decompress(a.read()) == gzip.decompress(b.read())  # the same records, in the same order
    with files.open_in(uri) as f:
        data = f.read()
    with files.published(uri) as out:
        out.write(data[: len(data) // 2])
    with pytest.raises(Exception, match="EOF|cut short|end-of-stream"):
        warc.normalise(whole)


def test_every_reference_resolves(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    ids, revisits = {}, []
    for r in warc.write(warc.roles(df, 100), common.fresh_path(spark, "w")).collect():
        with files.open_in(r.uri) as raw, gzip.GzipFile(fileobj=raw) as f:
            while (found := warc.parse(f)) is not None:
                ids[found[0]["warc-record-id"]] = found[0]
                if found[0]["warc-type"] == "revisit":
                    revisits.append(found[0])
    assert revisits
    for r in revisits:
        to = ids[r["warc-refers-to"]]
        assert to["warc-type"] == "response" and to["warc-payload-digest"] == r["warc-payload-digest"]
