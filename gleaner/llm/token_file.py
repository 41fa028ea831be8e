"""Token ids in files of length-delimited binary records, with a separate offset index.

A record is framed as: length (u64), masked checksum of those eight bytes (u32), data, masked checksum of the data (u32),
all little-endian.  The checksum is zlib's CRC-32, rotated right by 15 bits plus a constant, so that a record holding
records does not look valid by itself.  The data is: width of an id in bytes (u8: 2 or 4), whether there is a doc_id (u8),
doc_id (i64), ids.  <file>.idx holds offset and whole length (u64 each) of every record, for reads in any order.

Documents are written in ascending doc_id order (null first; equal ids by a hash of the text, then by text), over files
whose number in the name ascends with doc_id.  A null text gives the end id alone.  Repeated rows are written each.  An
empty table gives files without records and no rows; columns but doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, files

#: Fixed value of the record format's checksum mask.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
META = struct.Struct("<BBq")
PROBE = "The  QUICK bröwn,\tfox. É.g. jump'd\r\n over <|endoftext|> 12 lazy-dogs...\x0band ÀÇ\x0cend"
CACHE = 300_000  #: keys in a generation of a worker's two memos


def masked(data) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(size)) + data + struct.pack("<I", masked(data))


def unframe(read) -> bytes | None:
    """The next record of a file's read function, None at the end; ValueError if a checksum does not match."""
    head = read(HEAD.size)
    if not head:
        return None
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("damaged record length")
    data = read(size)
    if len(data) != size or read(4) != struct.pack("<I", masked(data)):
        raise ValueError("damaged record")
    return data


def read_index(uri: str) -> np.ndarray:
    """Offset and length of every record, one row each."""
    with files.open_in(uri + ".idx") as f:
        return np.frombuffer(f.read(), "<u8").reshape(-1, 2)


def read_at(uri: str, offset: int) -> bytes:
    """One record, found by its offset."""
    with files.open_in(uri) as f:
        f.seek(int(offset))
        return unframe(f.read)


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    width, has_id, doc_id = META.unpack_from(data)
    return doc_id if has_id else None, np.frombuffer(data, f"<u{width}", offset=META.size).astype("<u4")


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level models write bytes: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Units:
    """Ids of texts by the tokenizers library, which sees each distinct unit between ASCII white space once.

    The tokenizer drops white space and treats what stands between it separately, so the units' ids make up the text's.
    Latin letters, with or without full stops and commas behind them, are one or two pre-tokens: these go to the library's
    model in lower case, by its letters for bytes.  Any other unit goes through the whole library, which finds the literals of
    special tokens in it.  A tokenizer of which this does not hold gives other ids for PROBE and is refused with ValueError.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.type = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.units = common.Memo(CACHE, self.unit)
        self.parts = common.Memo(CACHE, self.part)
        if self.encode(PROBE) != array(self.type, self.tokenizer.encode(PROBE, add_special_tokens=False).ids).tobytes():
            raise ValueError(f"{path} does not treat words between white space separately, or in lower case")

    def part(self, s: str) -> bytes:
        return array(self.type, [t.id for t in self.model.tokenize(s.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def unit(self, unit: bytes) -> bytes:
        text = unit.decode()
        low = text.lower()
        word = low.rstrip(".,")
        if word.isalpha() and max(text) < "\u0250" and max(word) < "\u0250":
            return self.parts.find(word) + self.parts.find(low[len(word) :]) if len(word) < len(low) else self.parts.find(word)
        return array(self.type, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        known, find = self.units.young.get, self.units.find
        return b"".join([known(u) or find(u) for u in (text or "").encode().split()])


def units_of(path: str) -> Units:
    """One for each worker process."""
    return common.worker_table(("token_file", path), lambda: Units(path))


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return META.pack(width, doc_id is not None, doc_id or 0) + ids


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Write the documents' ids, each with end_id behind it, below folder; returns the manifest, a row for each file."""
    spark = docs.sparkSession
    common.ship(spark)
    files.make_dir(folder)
    parts = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(tokenizer)
        end, part = array(units.type, [end_id]).tobytes(), TaskContext.get().partitionId()
        uri, at, tokens, index = f"{folder}/tokens-{part:06d}.rec", 0, 0, []
        with files.published(uri) as out:
            for b in common.sliced(batches):
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = units.encode(text) + end
                    record = frame(pack(doc_id, ids, len(end)))
                    out.write(record)
                    index.append((at, len(record)))
                    at += len(record)
                    tokens += len(ids) // len(end)
        with files.published(uri + ".idx") as out:
            out.write(np.array(index, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [len(index)], "tokens": [tokens]})

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return common.spool(dealt.select("doc_id", "text").mapInArrow(run, "part long, uri string, n_docs long, tokens long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), ids of every record, in any order."""
    common.ship(manifest.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            doc_ids, starts, ids = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                rows, size = [], 0
                with files.open_in(uri) as f:
                    for offset, _ in read_index(uri):
                        f.seek(int(offset))
                        doc_id, ids = unpack(unframe(f.read))
                        rows.append((doc_id, start, ids.tobytes()))
                        start, size = start + len(ids), size + 4 * len(ids)
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    starts = manifest.select("part", "uri", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")).repartition(max(1, manifest.count()))
    return starts.mapInArrow(run, "doc_id long, start long, ids binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents, from the files."""
    import public_tokenizers

    folder = common.fresh_path(docs.sparkSession, "tokens")
    back = read(write(common.spread(docs), public_tokenizers.path("word_bpe_49k.json"), folder, 2))
    return back.select("doc_id", "start", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
