import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import cnn


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def net(spark, labels):
    return cnn.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)


def slow(net, text):
    """The network as its docstring has it, position by position."""
    n = max(1, -(-len(text) // cnn.SEGMENT))
    data = text + bytes(n * cnn.SEGMENT + cnn.WIDTH - len(text))
    values = np.array([sum(net.filters[j][data[k + j]] for j in range(cnn.WIDTH)) for k in range(n * cnn.SEGMENT)])
    logits, s = [], 0
    while True:
        part = values[s * cnn.SEGMENT : (s + cnn.PER_CHUNK) * cnn.SEGMENT]
        logits.append(np.maximum(part.max(0) + net.bias, 0) @ net.weights)
        s += cnn.STEP
        if s * cnn.SEGMENT >= len(values) or s > n - cnn.PER_CHUNK + cnn.STEP - 1:
            break
    return 1 / (1 + np.exp(-(np.mean(logits) + net.intercept)))


@pytest.mark.parametrize("size", [0, 1, 63, 64, 500, 512, 513, 960, 961, 3000])
def test_whole_text_is_covered(net, size, monkeypatch):
    text = (b"The and of %%% thing ere. " * 200)[:size]
    monkeypatch.setattr(cnn, "BLOCK", cnn.SEGMENT * 3)
    assert net.score(text) == pytest.approx(slow(net, text), abs=1e-4)


def test_held_out_accuracy(spark, labels, net):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = cnn.score(docs.select("doc_id", "text"), net).join(labels, "doc_id").where(cnn.held_out(F.col("doc_id"))).collect()
    right = [(r.score >= 0.7) == (r.quality == 1) for r in out]
    assert len(right) > 50 and sum(right) / len(right) >= 0.93


def test_contract(docs, clashing, empty, labels, rows):
    got = cnn.digests(docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    again = cnn.digests(clashing.drop("score"), labels).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in got)
    assert cnn.digests(empty, labels).count() == 0


def test_without_labels(docs, labels):
    assert {round(r.score, 6) for r in cnn.digests(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_rows_are_not_learned(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    flipped = labels.withColumn("quality", F.when(cnn.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (cnn.train(docs, x, 50) for x in (labels, flipped))
    assert (a.filters == b.filters).all()


def test_long_texts_are_fitted_on_stretches_of_all_of_it(spark):
    long = "".join(f"{k:07d} " for k in range(40_000))
    df = spark.createDataFrame([(1, long), (2, "short"), (3, "x" * cnn.LONGEST), (4, "é" * cnn.LONGEST)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.t) for r in df.select("doc_id", cnn.stretches(F.col("text").cast("binary")).alias("t")).collect()}
    assert got[2] == b"short" and got[3] == b"x" * cnn.LONGEST and len(got[4]) == cnn.LONGEST
    assert len(got[1]) == cnn.LONGEST
    size = cnn.LONGEST // cnn.PIECES
    at = [long.encode().find(got[1][k : k + size]) for k in range(0, cnn.LONGEST, size)]
    assert at == sorted(at) and at[0] >= 0 and at[0] < len(long) / cnn.PIECES and at[-1] > len(long) * (1 - 2 / cnn.PIECES)
