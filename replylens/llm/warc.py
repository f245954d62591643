"""WARC archives written and read as a chunked record table.

Payloads move as rows (record id, chunk number, bytes) of bounded size, each with the
digest of the payload up to its end, so no step holds a whole record but the one row that
already lies in the input.

Writing: tasks stream records into archives in the shared folder. A task that runs twice
writes another file under another name; the table of archives, which Spark commits, names
one file per finished task, and readers use only those. Nothing depends on the disk of an
executor. Every record is a gzip member of its own, as is usual for such archives.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.llm.common import checkpoint, pieces_of, stored
from replylens.session import scratch_path

CHUNK = 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_NULL = "\0"            # stands for a null id in record URIs
_NAMESPACE = uuid.UUID("6f6b1a52-3a0c-4d58-9a53-3f3c7a0d9d10")


def record_uri(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, key)}>"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, with or without a scheme."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_types(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, record_type, refers_to) of every row that revisits another.

    Equal payloads are found by digest and length; the largest id of a group responds.
    Only digests are shuffled, and groups are combined before the shuffle.
    """
    digests = pages.select("page_id", F.octet_length("html").alias("size"), F.sha1("html").alias("digest"))
    digests = digests.filter(F.col("size") >= min_bytes)
    # stored, so that the join shuffles both sides and a hot payload can be split
    groups = checkpoint(digests.groupBy("digest", "size")
                        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
                        .filter("n > 1").drop("n"))
    return (digests.join(groups, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct())


def _named(page: str) -> str:
    """An id as a header value: what is no ASCII letter, digit or ``-._~`` is percent-encoded."""
    return quote(page, safe="", errors="surrogatepass")


def _header(kind: str, page: str | None, url: str, size: int, digest: str, refers: str | None,
            length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(_NULL if page is None else page)}",
             f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
             *([] if page is None else [f"WARC-Page-ID: {_named(page)}"]),
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}",
             "Content-Type: application/http; msgtype=response"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_uri(refers)}", f"WARC-Refers-To-Page-ID: {_named(refers)}"]
    lines.append(f"Content-Length: {length}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """One WARC record per row of ``pages`` (page_id, url, html) in archives below ``folder``.

    Returns the committed table of archives (path, records, bytes). A null html is an
    empty payload, a null url an empty one. Rows that share id and html are written as
    often as they stand, each of the same type. Line breaks in a url are dropped. Ids are
    percent-encoded in the headers, so any text comes back as it was; a null id has no header.
    """
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"),
                         F.coalesce("html", F.lit("")).alias("html"))
    types = record_types(pages, min_bytes)
    joined = (pages.withColumn("_own", F.sha1("html"))
              .join(types, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_own") == F.col("_digest")), "left")
              .select(F.col("page_id").cast("string").alias("page"), "url",
                      F.col("html").cast("binary").alias("html"), F.col("_own").alias("digest"),
                      F.col("_page").isNotNull().alias("revisit"),
                      F.col("refers_to").cast("string").alias("refers_to")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = name = out = None
        records = written = 0
        for batch in pieces_of(batches, "html"):
            for row in range(batch.num_rows):
                page, url, html, digest, revisit, refers = (batch.column(c)[row] for c in range(6))
                if out is None:
                    store, base = open_store(folder)
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = memoryview(html.as_buffer())
                revisits = revisit.as_py()
                page = page.as_py()
                head = _header("revisit" if revisits else "response", page,
                               url.as_py().replace("\r", "").replace("\n", ""), len(payload), digest.as_py(),
                               refers.as_py() if revisits else None,
                               len(_HTTP) + (0 if revisits else len(payload)))
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                parts = [member.compress(head + _HTTP)]
                for at in range(0, 0 if revisits else len(payload), chunk):
                    parts.append(member.compress(payload[at:at + chunk]))
                    if sum(map(len, parts)) >= chunk:
                        written += out.write(b"".join(parts))
                        parts.clear()
                parts += [member.compress(b"\r\n\r\n"), member.flush()]
                written += out.write(b"".join(parts))
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([records], pa.int64()), pa.array([written], pa.int64())],
                names=["archive", "records", "bytes"])

    return stored(joined.mapInArrow(write, "archive string, records long, bytes long"), "archives")


class _Stream:
    """A forward reader with a buffer of bounded size."""

    def __init__(self, source, chunk: int):
        self.source, self.chunk, self.held = source, chunk, b""

    def line(self) -> bytes:
        """The next line without its end; empty bytes at the end of the file."""
        while (end := self.held.find(b"\n")) < 0:
            more = self.source.read(self.chunk)
            if not more:
                found, self.held = self.held, b""
                return found
            self.held += more
        found, self.held = self.held[:end], self.held[end + 1:]
        return found.rstrip(b"\r") or b"\r"

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in parts of one chunk."""
        while n:
            if not self.held:
                self.held = self.source.read(self.chunk)
                if not self.held:
                    raise ValueError("an archive ends inside a record")
            part, self.held = self.held[:min(n, self.chunk)], self.held[min(n, self.chunk):]
            n -= len(part)
            yield part


def read_records(source, chunk: int = CHUNK) -> Iterator[tuple]:
    """(page, url, type, refers_to, size, chunk number, last, bytes, running digest) by chunk.

    Every record has one row at least. The digest of a chunk is that of the payload from
    its start to the end of this chunk; that of a revisit is the one it names.
    """
    stream = _Stream(source, chunk)
    while first := stream.line():
        if first == b"\r":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {first[:40]!r}")
        head = {}
        while (line := stream.line()) not in (b"\r", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.lower()] = value.strip()
        left = int(head["content-length"])
        taken = 0
        while (line := stream.line()) not in (b"\r", b""):      # the HTTP header
            taken += len(line) + 2
        left -= taken + 2
        page, refers = (None if (id_ := head.get(h)) is None else unquote(id_, errors="surrogatepass")
                        for h in ("warc-page-id", "warc-refers-to-page-id"))
        about = (page, head["warc-target-uri"], head["warc-type"], refers, int(head["warc-payload-length"]))
        if head["warc-type"] == "revisit" or not left:
            named = head["warc-payload-digest"].removeprefix("sha1:")
            yield (*about, 0, True, b"", named if head["warc-type"] == "revisit" else hashlib.sha1().hexdigest())
            continue
        digest, number = hashlib.sha1(), 0
        held = bytearray()
        while left:
            for part in stream.take(min(chunk - len(held), left)):
                held += part
                left -= len(part)
            if len(held) == chunk or not left:
                digest.update(held)
                yield (*about, number, not left, bytes(held), digest.hexdigest())
                held.clear()
                number += 1


CHUNKS = ("page string, url string, record_type string, refers_to string, payload_length long, "
          "chunk int, last boolean, data binary, digest string")


def read_archives(spark: SparkSession, folder: str, archives: DataFrame, chunk: int = CHUNK,
                  with_data: bool = True) -> DataFrame:
    """The chunk table of archives: one row per record and chunk, in order of the file.

    ``with_data=False`` leaves the bytes null; digests and lengths are still computed from
    the archive.
    """
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in CHUNKS.split(", ")] + ["n_bytes"]

    def read(batches):
        store, base = open_store(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as packed, \
                        gzip.GzipFile(fileobj=packed) as source:
                    for record in read_records(source, chunk):
                        held += len(record[7])
                        rows.append((*record[:7], record[7] if with_data else None, record[8], len(record[7])))
                        if held > 32 * chunk or len(rows) > 5000:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # one task per archive
    paths = archives.select("archive").repartition(spark.sparkContext.defaultParallelism, "archive")
    return paths.mapInArrow(read, CHUNKS + ", n_bytes long")


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000,
               chunk: int = CHUNK) -> DataFrame:
    """Writes ``pages`` and reads the archives back: one row per record.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to), computed from
    the chunk table. Lengths and digests of responses are those of the bytes read; those of
    revisits are what their record names, since their payload is stored once.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    archives = write_archives(pages, folder, min_bytes, chunk)
    kind = pages.schema["page_id"].dataType
    rows = read_archives(spark, folder, archives, chunk, with_data=False)
    # the last chunk of a record carries the whole digest; chunk n starts at n times the size
    whole = rows.filter("last")
    stored_bytes = F.when(F.col("record_type") == "revisit", F.col("payload_length")).otherwise(
        F.col("chunk").cast("long") * chunk + F.col("n_bytes"))
    return whole.select(F.col("page").cast(kind).alias("page_id"), stored_bytes.alias("payload_bytes"),
                        F.col("digest").alias("payload_digest"), "record_type",
                        F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes
  from pages),
g as (select *, max(page_id) over (partition by html) as biggest from p)
select page_id, payload_bytes, sha1(html) as payload_digest,
  case when payload_bytes >= 1000 and page_id <> biggest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> biggest then biggest end as refers_to
from g"""
