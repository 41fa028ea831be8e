import shutil
from array import array

import public_tokenizers as P
import pytest
import test_decontaminate
import test_jaccard_join
import test_secrets
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import byte_bpe, cnn, secrets


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """The generated tables with odd rows added to documents."""
    to = tmp_path_factory.mktemp("sf")
    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", to)
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    more = [(700_000, f"Of the and that {item} in the and"), (700_001, "The rest of that is this one here with token = 'abcdefgh12' " + "and of the long line. " * 3)]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in more], docs.schema)
    docs.unionByName(extra).coalesce(2).write.parquet(f"{to}/documents.parquet")
    return str(to)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_free", "without_secrets", "encoded"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = cnn.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if net.score((r.text or "").encode()) >= corpus_pipeline.QUALITY]
    labels = {i: c for i, _, c in test_jaccard_join.brute(rows, corpus_pipeline.WORDS, corpus_pipeline.PERCENT)}
    kept = {}
    for i, t in rows:
        if i is not None and labels[i] == i:
            kept.setdefault(i, t)
    rows = list(kept.items()) + [(i, t) for i, t in rows if i is None]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r, hit in zip(rows, test_decontaminate.brute(rows, items), strict=True) if not hit[1]]

    def masked(t):
        own = [(m.start(), 3 + k, m.end(), r.kind) for k, r in enumerate(secrets.OWN) for m in __import__("re").finditer(r.pattern, t or "")]
        at, out = 0, ""
        for s, _, e, kind in sorted(test_secrets.base(t) + own):
            if s >= at:
                out += (t or "")[at:s] + f"<{kind}>"
            at = max(at, e)
        return out + (t or "")[at:]

    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted(((i if i is not None else -1), oracle.encode_ordinary(masked(t))) for i, t in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, array("I", bytes(r.ids)).tolist()) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want
    ids = {i for i, _ in got}
    assert 700_000 not in ids and 700_001 in ids


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30).withColumn("extra", F.lit(1)), folder).columns == list(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
