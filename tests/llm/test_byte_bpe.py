import hashlib
import random
import struct
from array import array

import public_tokenizers as P
import pytest
import tiktoken

from gleaner.llm import byte_bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_random_texts_match_the_library(oracle):
    coder, rng = byte_bpe.coder(RANKS, P.PATTERN), random.Random(1)
    letters = "ab \n\t  'sSée\x1c\x85\xa0　Ⅻ½1２.,!-_́日本​\U0001f600"
    for _ in range(5000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 16)))
        ids = coder.encode(s)
        assert array("I", ids).tolist() == oracle.encode_ordinary(s), repr(s)


def test_long_piece_in_linear_time(oracle):
    s = "ab" * 50_000
    assert array("I", byte_bpe.coder(RANKS, P.PATTERN).encode(s)).tolist() == oracle.encode_ordinary(s)


def expected(rows, oracle):
    out = []
    for i, t in rows:
        ids = oracle.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_digests(docs, clashing, empty, rows, oracle, same):
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    same(byte_bpe.digests(docs), columns, expected(rows, oracle))
    same(byte_bpe.digests(clashing), columns, expected(rows, oracle))
    assert byte_bpe.digests(empty).count() == 0


def test_clashing_output_is_refused(clashing):
    with pytest.raises(ValueError):
        byte_bpe.encode(clashing, RANKS, P.PATTERN)
