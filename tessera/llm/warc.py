"""WARC archives: writing, and sequential reading with verification.

Each record is one gzip member: a WARC/1.1 header, an HTTP header and the
payload. Records of equal payloads point at one response as revisits and carry
no payload. A reader feeds the archive in pieces to an incremental zlib
decompressor, frames each record by its Content-Length and holds block and
payload against their digests.

An archive is one binary value of a Parquet table in the shared folder, so that
Spark's committer writes it to any store; ``export`` writes plain ``.warc.gz``
files. ``read_folder`` reads such files, anyone's: each is opened where it lies and
fed to the reader in pieces, so an archive of any size takes the memory of its
largest record. Digests are optional in the format and checked where they are given.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.storage import written

#: An archive closes with the record that reaches this many compressed bytes.
ARCHIVE_BYTES = 8 << 20
#: Payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 0
#: Parts of a payload digest's rows in the join with its response, so that one payload of very many pages is spread.
SALTS = 32
_FEED = 64 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(raw: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


_OWN = "<urn:tessera:page:"


def _record_id(page: int | None) -> str:
    return f"{_OWN}{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, level: int = 6) -> bytes:
    """One record as a gzip member; a revisit where ``refers_to`` names the page of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    whole = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


@dataclass
class Record:
    """A record as read: its headers, the header fields of its HTTP message if it holds one, and its payload."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass" if _is_utf8(raw) else "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return False
    return True


def _members(feed: Iterable[bytes]) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, however its bytes are cut."""
    unpack, parts = zlib.decompressobj(31), []
    for piece in feed:
        while piece:
            parts.append(unpack.decompress(piece))
            piece = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a member")


def _holds(stated: str | None, raw: bytes) -> bool:
    """Whether ``raw`` has the stated digest: SHA-1 in base32 or hex; other algorithms are not checked."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() != "sha1":
        return True
    found = hashlib.sha1(raw).digest()
    return value.upper() in (base64.b32encode(found).decode(), found.hex().upper())


def read(feed: Iterable[bytes]) -> Iterator[Record]:
    """Records of an archive in order; raises ValueError where framing or a stated digest does not hold.

    A payload is what follows the header of an HTTP message, and the whole block of
    any other record. A payload digest covers a response's payload; a revisit states
    the digest of a payload that it does not carry.
    """
    for member in _members(feed):
        head, mark, rest = member.partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"WARC/"):
            raise ValueError("a member is not a WARC record")
        headers = _fields(head)
        name = headers.get("warc-record-id")
        if not headers.get("content-length", "").isdigit():
            raise ValueError(f"{name}: no length is stated")
        size = int(headers["content-length"])
        block, tail = rest[:size], rest[size:]
        if len(block) != size or tail != b"\r\n\r\n":
            raise ValueError(f"{name}: the block is not as long as stated")
        if not _holds(headers.get("warc-block-digest"), block):
            raise ValueError(f"{name}: the block differs from its digest")
        kind = headers.get("warc-type", "")
        if headers.get("content-type", "").lower().startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            found = Record(headers, _fields(top), payload)
        else:
            found = Record(headers, {}, block)
        stated = found.http.get("content-length", "")
        encoded = "transfer-encoding" in found.http or "content-encoding" in found.http
        whole = kind in ("response", "resource") and "warc-truncated" not in headers and "warc-segment-number" not in headers
        if whole and not encoded and (not _holds(headers.get("warc-payload-digest"), found.payload) or (stated.isdigit() and len(found.payload) != int(stated))):
            raise ValueError(f"{name}: the payload differs from its digest or length")
        yield found


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """The written table (part, archive, content) with one record a row of ``pages``.

    Of rows with equal payloads of ``min_revisit_bytes`` bytes or more, that with
    the largest id is the response and the others revisit it; rows repeated with
    that id are responses too. Null payloads are empty; rows without an id are
    responses where no row of the payload has one. Only payloads that occur more
    than once are joined; their rows are spread over ``SALTS`` parts. Ids are integers.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    keyed = rows.withColumn("key", F.when(F.octet_length("body") >= min_revisit_bytes, F.sha2("body", 256)))
    several = keyed.where("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    salted = several.where("n > 1 AND first IS NOT NULL").select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    aimed = dealt.join(salted, ["key", "salt"], "left").select(
        "id", "url", "body", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def archives(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([b"".join(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "archive", "content"])

        for b in batches:
            for page, url, raw, target in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2), b.column(3).to_pylist(), strict=True):
                held.append(record(page, url, raw.as_py(), target))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return written(aimed.mapInArrow(archives, "part int, archive int, content binary"), "warc")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"
#: Records handed on at once.
READ_ROWS = 1024


def _page(name: str | None) -> int | None:
    """The page of a record id of our own; null for others."""
    tail = (name or "").removeprefix(_OWN).removesuffix(">")
    return int(tail) if (name or "").startswith(_OWN) and tail.lstrip("-").isdigit() else None


def _rows(feed: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """The records of one archive as rows."""
    out: list[list] = [[] for _ in range(7)]

    def batch() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in _READ.split(", ")])
        for column in out:
            column.clear()
        return made

    for r in read(feed):
        h = r.headers
        length = r.http.get("content-length", "")
        given = h.get("warc-payload-digest", "").removeprefix("sha1:") or digest(r.payload)
        values = (
            _page(h.get("warc-record-id")), int(length) if length.isdigit() else len(r.payload), given, h.get("warc-type"),
            _page(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-record-id"),
        )
        for column, value in zip(out, values, strict=True):
            column.append(value)
        if len(out[0]) >= READ_ROWS:
            yield batch()
    if out[0]:
        yield batch()


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """One row a record of the archives in ``content_col``: page, full payload's length and digest, type, target, url, record id.

    Page and target are null for records that ``write_archives`` did not write.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                if content.is_valid:
                    raw = memoryview(content.as_buffer())
                    yield from _rows(raw[i : i + _FEED] for i in range(0, len(raw), _FEED))

    return archives.select(F.col(content_col).cast("binary")).mapInArrow(rows, _READ)


def _opened(path: str) -> Iterator[bytes]:
    """The bytes of a file in pieces, from any file system that Arrow can open."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if ":" in path else "file://" + path)
    with store.open_input_file(name) as f:
        while piece := f.read(_FEED):
            yield piece


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ``*.warc.gz`` files below ``path``, which Spark lists and the executors open one after another.

    Each file is read as a stream. The store must be one that Arrow opens by URI (local, hdfs, s3, gs, abfs).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    names = written(files.select("path"), "warc-names")  # the listing alone, without contents
    tasks = max(1, min(names.count(), spark.sparkContext.defaultParallelism * 4))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                yield from _rows(_opened(name))

    return names.repartition(tasks).mapInArrow(rows, _READ)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write every archive as a ``.warc.gz`` file below a local folder, one at a time; returns their names."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for row in archives.select("part", "archive", "content").toLocalIterator():
        names.append(os.path.join(folder, f"{row['part']:06d}-{row['archive']:06d}.warc.gz"))
        with open(names[-1], "wb") as out:
            out.write(row["content"])
    return names
