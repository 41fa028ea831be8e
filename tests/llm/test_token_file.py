import random
import struct
import zlib
from array import array

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gleaner.llm import common, files, token_file

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_digests(docs, empty, rows, library):
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_file.digests(docs).collect()), key=lambda r: r[1])
    ids = [(i if i is not None else -1, (*x, 2)) for (i, t), x in zip(rows, library([t for _, t in rows]), strict=True)]
    assert [r[0] for r in got] == sorted(i for i, _ in ids)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in ids)
    assert token_file.digests(empty).count() == 0


def test_units_match_the_library(library):
    rng, units = random.Random(2), token_file.units_of(PATH)
    letters = ["a", "B", "é", "É", "ß", "İ", "ſ", "ŉ", "ŸΣ", "ς", "e\u0301", "H\u0331", "K", "1", "½", ".", ",", "..", "'s", "'", "-", " ", "\n", "\u00a0", "\u2003", "\x1c", "日", "😀", "ʼ", "ª", "º", "µ", "ǅ", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(6000)]
    for text, want in zip(texts, library(texts), strict=True):
        assert array("H", units.encode(text)).tolist() == want, repr(text)


def test_special_tokens_are_read_as_the_library_does():
    assert array("H", token_file.units_of(PATH).encode("see <|endoftext|> here")).tolist() == [862, 49407, 763]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="separately"):
        token_file.Units(P.path("byte_bpe_50k.json"))


def test_extra_columns_are_not_read(docs, clashing):
    a, b = (sorted(map(tuple, token_file.digests(x).collect()), key=repr) for x in (docs, clashing))
    assert a == b


def test_a_second_attempt_replaces_the_first(spark):
    uri = common.fresh_path(spark, "twice")
    for data in (b"first", b"second"):
        with files.published(uri) as out:
            out.write(data)
    with files.open_in(uri) as f:
        assert f.read() == b"second"


def test_shuffled_reads_and_damage(spark, docs):
    folder = common.fresh_path(spark, "t")
    uri = max(token_file.write(docs, PATH, folder, 2).collect(), key=lambda r: r.n_docs).uri
    index = token_file.read_index(uri)
    offsets = list(index[:, 0])
    first = [token_file.unpack(token_file.read_at(uri, o))[0] for o in offsets[::-1]][::-1]
    assert first == sorted(first, key=lambda x: -1 if x is None else x) and len(first) > 1
    with files.open_in(uri) as f:
        data = bytearray(f.read())
    data[int(index[1].sum()) - 5] ^= 1  # the last byte of its data, however short it is
    with files.published(uri) as out:
        out.write(bytes(data))
    token_file.read_at(uri, offsets[0])
    with pytest.raises(ValueError):
        token_file.read_at(uri, offsets[1])
