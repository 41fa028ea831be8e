import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, odd white space, letters outside ASCII, secrets, licences and a long text.
ODD = [
    None, "", " ", "\n\n \t", "word", "a b c", "a b c d", "  lead  and\n\n trail \n", "x\x0by\x0cz\x1cq r s", "É́ ÀΣ ΑΣ İ K \U0001f600 日本語 ½ Ⅻ ２",
    "the same line here\nthe same line here\nthe same line here\nanother", "from " * 300, "AKIA" + "A1" * 9 + " password: 'hunter2222' 😀 token=abc token=token=abcdefgh secret:token:abcdefgh " + "0af" * 11,
    "Released under the MIT License. Licensed under CC BY-NC 4.0. Apache License, Version 2.0 under the mit license", "don't we'll I'D 's 't’s  two   three    four\r\n\tend ", "%%% ### $$$ " * 40,
    "ghp_" + "aB3" * 14 + "\n-----BEGIN RSA PRIVATE KEY-----\neyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "long " + "wordy text goes on. " * 6000, "<|endoftext|> <|startoftext|>x",
]


@pytest.fixture(scope="session")
def rows(spark):
    """(doc_id, text): generated documents and odd ones, some repeated, one doc_id null."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(100_000 + k, t) for k, t in enumerate(ODD)]
    return docs + odd + odd[4:6] + [(None, "no id, password = abcdefgh"), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns, with names that operators use."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("h", "ids", "w", "words", "key", "n", "digest", "kept", "score", "spans", "rules", "uid", "sig", "node", "a", "b", "label", "owner", "side", "item", "run", "off", "part", "uri", "turn", "line")})


@pytest.fixture(scope="session")
def same():
    """Rows of a data frame against expected tuples, in any order."""

    def check(df, columns, expected):
        got = [tuple(r[c] for c in columns) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)

    return check
