"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters so that a pyahocorasick trie holds the vocabulary.  A piece is encoded by
backtracking from longest matches: a token may follow another only if the two are adjacent in the BPE of their
concatenation, a fact memoised for each pair.  A sequence whose neighbours are all compatible is the BPE of the piece, and
every prefix has just one such sequence, so a position that fails is never tried again: time is linear.  Where a match does not
fit, the next one tried is the longest token that is a proper prefix of it, from a table.

Defined results: a null text is encoded like an empty one (no ids); repeated rows are encoded each; an empty table gives no
rows; input columns whose names clash with an output column are refused with ValueError.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: \s of the Rust engines: the White_Space property (Python's also has \x1c to \x1f).
SPACE = r"\t-\r\x20\x85\xa0  -     　"
CACHE = 200_000  #: keys in a generation of a worker's two memos
PAIRS = 1_000_000  #: entries of the memo of pairs (in proportion, if the memos are smaller)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder over a rank file.  pattern splits a text into pieces, as in the tiktoken library."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        ranks = read_ranks(path)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.longest = max(map(len, self.pieces))
        self.memo: dict[int, bool] = {}
        self.pairs = PAIRS * cache // CACHE
        self.units = common.Memo(cache, self.word)
        self.found = common.Memo(cache, lambda p: array("I", self.piece(p.encode().decode("latin-1"))).tobytes())
        # A token that its own merges do not produce is only ever found as a whole piece.
        self.inner = {s: i for s, i in self.pieces.items() if self.merged(s) == [i]}
        self.trie = ahocorasick.Automaton()
        for s, i in self.inner.items():
            self.trie.add_word(s, i)
        self.lengths = {i: len(s) for s, i in self.inner.items()}
        self.shorter = {i: next((self.inner[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.inner), -1) for s, i in self.inner.items()}
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s+", f"[{SPACE}]+").replace(r"\S", f"[^{SPACE}]")).findall
        # A single space between two other characters always opens a piece: texts are cut there, and units are cached.
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.odd = re.compile(r"[^\S\n ]").search

    def ragged(self, text: str) -> bool:
        """Whether a blank may stand beside other white space or at an end, or there is white space but blanks and line ends."""
        return "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or self.odd(text) is not None

    def merged(self, s: str) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank until none is left."""
        parts, rank = list(s), self.pieces.get
        while len(parts) > 1:
            best, at = min((rank(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.pieces[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.memo.get(key)) is None:
            if len(self.memo) >= self.pairs:
                self.memo.clear()
            known = self.memo[key] = self.merged((self.bytes_of[a] + self.bytes_of[b]).decode("latin-1")) == [a, b]
        return known

    def piece(self, s: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        if (whole := self.pieces.get(s)) is not None:
            return [whole]
        size, longest, inner, prefix, memo, shorter, lengths = len(s), self.longest, self.inner.get, self.trie.longest_prefix, self.memo.get, self.shorter, self.lengths
        ids: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, before = 0, -1
        n = prefix(s[:longest])
        while (token := inner(s[:n])) is None:  # a path of the trie may end between tokens
            n -= 1
        while True:
            while token >= 0:
                end = at + lengths[token]
                if end not in dead:
                    if before < 0:
                        break
                    fits = memo(before << 32 | token)
                    if fits or fits is None and self.compatible(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                if end == size:
                    return ids
                starts.append(at)
                at, before = end, token
                n = at + prefix(s[at : at + longest])
                while (token := inner(s[at:n])) is None:
                    n -= 1
            else:
                dead.add(at)
                token, at = shorter[ids.pop()], starts.pop()
                before = ids[-1] if ids else -1

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known, find = self.units.young.get, self.units.find
        first, *rest = self.cut(text) if self.ragged(text) else text.split(" ")
        return self.unit(first) + b"".join([known(x) or find(x) for x in rest])

    def decode(self, ids: bytes | None) -> bytes:
        return decoded(self.bytes_of, ids)

    def word(self, x: str) -> bytes:
        """Ids of a blank and a unit behind it: ASCII letters are one piece with the blank, a full stop or comma behind them is another."""
        if x.isascii():
            if x.isalpha():
                return array("I", self.piece(" " + x)).tobytes()
            if x[-1] in ".," and x[:-1].isalpha():
                return self.units.find(x[:-1]) + self.found.find(x[-1])
        return self.unit(" " + x)

    def unit(self, x: str) -> bytes:
        return b"".join(map(self.found.find, self.split(x)))


def decoded(table: dict[int, bytes], ids: bytes | None) -> bytes:
    return b"".join(map(table.__getitem__, array("I", ids or b"")))


def coder(path: str, pattern: str, cache: int = CACHE) -> ByteBPE:
    """One for each worker process."""
    return common.worker_table(("byte_bpe", path, pattern, cache), lambda: ByteBPE(path, pattern, cache))


def _added(df: DataFrame, columns: list[str], make) -> DataFrame:
    """df with binary columns; make() gives a function of a batch that returns them."""
    if clash := sorted({c.lower() for c in columns} & {c.lower() for c in df.columns}):
        raise ValueError(f"the input has columns {clash} already")
    common.ship(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = None
        for b in common.sliced(batches):
            to = to or make()
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.binary()) for x in to(b))], [*names, *columns])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(c, T.BinaryType()) for c in columns)]))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", verify: bool = False, cache: int = CACHE) -> DataFrame:
    """df with the column out: the ids of text, packed as little-endian unsigned 32-bit integers.  cache: keys of a memo.

    With verify they are decoded in the same pass; ids that do not give the text back are a ValueError.
    """

    def make():
        c, at = coder(path, pattern, cache), df_columns.index(text)

        def one(x: str | None) -> bytes:
            ids = c.encode(x)
            if verify and c.decode(ids) != (x or "").encode():
                raise ValueError("ids that do not decode to their text")
            return ids

        return lambda b: [[one(x) for x in b.column(at).to_pylist()]]

    df_columns = df.columns
    return _added(df, [out], make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column out: the bytes that packed ids stand for (null ids: empty).  An id that the vocabulary lacks is a KeyError."""

    def make():
        table, at = {i: b for b, i in read_ranks(path).items()}, df_columns.index(ids)
        return lambda b: [[decoded(table, x) for x in b.column(at).to_pylist()]]

    df_columns = df.columns
    return _added(df, [out], make)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encode() and then decode() in one pass, by one Python worker."""

    def make():
        c, at = coder(path, pattern), df_columns.index(text)

        def both(b):
            coded = [c.encode(x) for x in b.column(at).to_pylist()]
            return coded, [c.decode(x) for x in coded]

        return both

    df_columns = df.columns
    return _added(df, [ids, out], make)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents."""
    import public_tokenizers

    coded = round_trip(common.spread(docs.select("doc_id", "text")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
