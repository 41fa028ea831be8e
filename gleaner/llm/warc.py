"""WARC archives: writing, normalising whole-file gzip, and reading through an offset index.

write() makes archives of one gzip stream each.  normalise() inflates such a stream once, rewrites every record as a gzip
member of its own and writes a sidecar index (offset and length of each member).  read() fetches members by the index.

Of equal payloads of at least min_bytes, the row with the smallest page_id is a response and the others are revisits, which
hold no payload but its digest and length, and refer to the response by its record id, which page_id and digest make up.
A null html is an empty payload; a null page_id takes no part in deduplication and stays a response; rows that repeat the
smallest page_id are responses as well (whole copies of a row share the record id).  Line ends in a url are written as
blanks.  An empty table gives archives without pages and no rows.  Columns but page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses).

    Roles are decided on page_id and digest alone; the list of revisits meets the pages by both, so that a common page is dealt
    out, and is broadcast where it is counted to be short.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    sized = rows.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    copies = sized.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id")
    revisits = sized.join(copies, "digest").where("page_id > first_id").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first_id").distinct()
    revisits = common.small(common.spool(revisits, "revisits"))
    return rows.join(revisits, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "payload", "digest", F.col("first_id").alias("refers_to"))


def response_id(page_id: int, digest: str) -> str:
    return f"<urn:gleaner:page:{page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, name: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + (payload if refers_to is None else b"")
    own = f"<urn:gleaner:record:{name}>" if page_id is None or refers_to is not None else response_id(page_id, digest)
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {response_id(refers_to, digest)}", f"X-Payload-Length: {len(payload)}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(f) -> tuple[dict[str, str], bytes, bytes] | None:
    """Header fields, block and raw bytes of the next record; None at the end, ValueError if it is damaged."""
    raw = [f.readline()]
    if not raw[0]:
        return None
    if not raw[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {raw[0][:40]!r}")
    fields = {}
    while (line := f.readline()) not in (b"\r\n", b""):
        raw.append(line)
        key, _, value = line.decode().partition(":")
        fields[key.lower()] = value.strip()
    size = int(fields["content-length"])
    block, end = f.read(size), f.read(4)
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, block, b"".join([*raw, line, block, end])


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write archives of one gzip stream; returns the manifest (part, uri)."""
    common.ship(rows.sparkSession)
    files.make_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, n = f"{folder}/pages-{part:06d}.warc.gz", 0
        with files.published(uri) as raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1, mtime=0) as out:
            for b in common.sliced(batches):
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    out.write(record(*row, f"{part}-{n}"))
                    n += 1
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri]})

    return common.spool(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "part long, uri string"), "archives")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite archives so that every record is a gzip member, with an index beside each; returns the manifest."""
    common.ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, uri in zip(b.column("part").to_pylist(), b.column("uri").to_pylist(), strict=True):
                to, at, index = uri.replace(".warc.gz", ".members.warc.gz"), 0, []
                with files.open_in(uri) as raw, gzip.GzipFile(fileobj=raw) as f, files.published(to) as out:
                    while (found := parse(f)) is not None:
                        member = gzip.compress(found[2], 6, mtime=0)
                        out.write(member)
                        index.append((at, len(member)))
                        at += len(member)
                with files.published(to + ".idx") as out:
                    out.write(np.array(index, "<u8").tobytes())
                yield pa.RecordBatch.from_pydict({"part": [part], "uri": [to]})

    return common.spool(archives.repartition(max(1, archives.count())).mapInArrow(run, "part long, uri string"), "members")


def read(members: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits) of every record."""
    common.ship(members.sparkSession)
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def row(data: bytes):
        import io

        fields, block, _ = parse(io.BytesIO(zlib.decompress(data, 31)))
        page_id = int(fields["x-page-id"]) if "x-page-id" in fields else None
        if fields["warc-type"] == "revisit":
            return page_id, fields["warc-target-uri"], "revisit", int(fields["x-payload-length"]), fields["warc-payload-digest"].partition(":")[2], int(fields["warc-refers-to"].split(":")[3]), None
        payload = block.partition(b"\r\n\r\n")[2]
        return page_id, fields["warc-target-uri"], "response", len(payload), hashlib.sha256(payload).hexdigest(), None, payload

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for uri in b.column("uri").to_pylist():
                with files.open_in(uri + ".idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).tolist()
                rows, size = [], 0
                with files.open_in(uri) as f:
                    for offset, length in index:
                        f.seek(offset)
                        rows.append(row(f.read(length)))
                        size += rows[-1][3]
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return members.repartition(max(1, members.count())).mapInArrow(run, schema)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of pages, from the archives read back."""
    folder = common.fresh_path(pages.sparkSession, "warc")
    back = read(normalise(write(roles(common.spread(pages), 100), folder)))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
