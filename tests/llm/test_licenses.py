import re

import pytest

from gleaner.llm import licenses as L

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def base(text):
    w = words(text)
    found = [(k, label) for label, phrase in L.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_columns(docs, clashing, empty, rows, same):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = [(i, *base(t)) for i, t in rows]
    assert any(r[2] > 1 for r in want)
    same(L.digests(docs), columns, want)
    same(L.digests(clashing), columns, want)
    assert L.digests(empty).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"),
        ("x " * 50 + "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction" + " y" * 50, "mit"),
        ("permission is hereby granted to copy of this software and nothing of the rest", ""),
        ("under the mit license under the mit license", "mit"),
        ("", ""),
    ],
)
def test_labels(spark, text, labels):
    row = L.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.labels == labels and (row.score > 0) == bool(labels) and row.score <= 1


def test_edited_copies_of_whole_texts(spark):
    """Every license text, with each thirtieth word replaced, some words put in, and prose around it."""
    rows = []
    for k, (_, text) in enumerate(L.TEXTS):
        w = text.split()
        for j in range(7, len(w), 30):
            w[j] = f"edited{j}"
        w[len(w) // 2 : len(w) // 2] = ["Jane", "Doe"]
        rows.append((k, "Some prose before. " * 5 + " ".join(w) + " and more prose behind."))
        rows.append((1000 + k, " ".join(w[: len(w) // 3 : 2])))
    got = {r.doc_id: r for r in L.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _) in enumerate(L.TEXTS):
        assert label in got[k].labels.split(","), label
        assert got[k].score >= L.COVER
        assert got[1000 + k].labels == ""
