"""WARC archives of web pages: a writer with revisit records, and a sequential reader.

An archive is the content of a .warc.gz file: one gzip member for each record. Archives are written as
rows (archive, bytes) of bounded size, so that any store Spark can write holds them; `read_files` reads
.warc.gz files instead. The reader walks an archive once: it feeds zlib small pieces, takes the header
up to the blank line, then as many bytes as Content-Length says, and checks the payload digest (of
responses, where they state one in SHA-256 or SHA-1, in hex or base32) and the end of the member. Other people's
archives read as well: records without an HTTP block (warcinfo, metadata, resource, ...) have their whole block as payload, HTTP
ones need no length of their own, and records without a digest have none checked. Memory: one archive of
about `archive_bytes`, or of a file a piece at a time where it is larger, and one header.

Among records with equal payloads of at least `least` bytes the one with the smallest page_id is the
response; the others are revisits that refer to it. Digests are summed before the shuffle, and a hot
payload is a skewed join that Spark splits.

Defined cases: a null html is an empty payload; a null url is an empty header value; a null page_id is
never chosen as a response that others refer to, unless its group has no id at all, and is then a
response itself; rows that repeat the chosen page_id are responses too; blanks in a url are encoded;
other columns are ignored; an empty table gives no archives and an empty result. A damaged archive (bad
digest, length or gzip member, or a truncated one) raises ValueError rather than yielding less.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.shared import shared_folder

ARCHIVE_BYTES, PIECE = 2 << 20, 1 << 16
LEAST_REVISITED = 100


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    uri = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def _write(archive_bytes: int, date: str):
    def run(batches):
        from pyspark import TaskContext

        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{made:06d}"]), pa.array([b"".join(held)], pa.large_binary()).cast(pa.binary())], names=["archive", "bytes"])

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, first = (batch.column(i)[row].as_py() for i in range(5))
                revisit = first is not None and page_id != first
                held.append(_record(page_id, url, (html or "").encode(), digest, first, revisit, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    made, held, size = made + 1, [], 0
        if held:
            yield archive()

    return run


def archives(pages: DataFrame, least: int = LEAST_REVISITED, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, bytes): WARC archives of pages (page_id, url, html), one record for each row."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumn("digest", F.sha2(body, 256))
    firsts = rows.where(F.octet_length(body) >= least).groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # payloads too small to be revisited meet nothing: keys of their own spread them
    rows = rows.withColumn("key", F.when(F.octet_length(body) >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    rows = rows.join(firsts.where("n > 1").drop("n"), F.col("key") == F.col("same"), "left")
    return rows.select("page_id", "url", "html", "digest", "first").mapInArrow(_write(archive_bytes, date), "archive string, bytes binary")


def pieces(data: bytes) -> Iterator[bytes]:
    """The bytes in small pieces, as from a stream."""
    view = memoryview(data)
    for at in range(0, len(view), PIECE):
        yield view[at : at + PIECE]


def records(stream: Iterable[bytes], keep_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order.

    Each is a dict with `headers` (lower-case names), `payload_bytes` and `payload_digest`, the SHA-256 of the full
    payload (for revisits both as their headers state them, with any digest they name) and, on demand, `payload`.
    """
    source, rest = iter(stream), b""
    while True:
        while not rest:
            piece = next(source, None)
            if piece is None:
                return
            rest = bytes(piece)
        member, held = zlib.decompressobj(31), bytearray()

        def more() -> bool:
            """One more piece of the member into `held`; false at its end."""
            nonlocal rest
            if member.eof:
                return False
            if not rest:
                piece = next(source, None)
                if piece is None:
                    raise ValueError("truncated archive: a gzip member does not end")
                rest = bytes(piece)
            try:
                held.extend(member.decompress(rest, PIECE))
            except zlib.error as e:
                raise ValueError(f"damaged gzip member: {e}") from e
            rest = member.unused_data if member.eof else member.unconsumed_tail
            return True

        def head() -> tuple[list[str], int]:
            """Lines up to the blank one, and the bytes of all."""
            nonlocal held
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not more():
                    raise ValueError("a header does not end")
            lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
            del held[: end + 4]
            return lines, end + 4

        fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        (first, *lines), _ = head()
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = fields(lines)
        if not headers.get("content-length", "").isdigit():
            raise ValueError("a record has no Content-Length")
        left, stated = int(headers["content-length"]), None
        if headers.get("content-type", "").lower().startswith("application/http") and left:
            http, size = head()
            left -= size
            stated = fields(http[1:]).get("content-length")
        algorithm, _, told = headers.get("warc-payload-digest", "").partition(":")
        made = {"sha1": hashlib.sha1, "sha256": hashlib.sha256}.get(algorithm.lower().replace("-", ""))
        digest, got, kept = hashlib.sha256(), 0, bytearray()
        check = made() if made else None
        while got < left:
            if not held and not more():
                raise ValueError("a block is shorter than its Content-Length")
            part = bytes(held[: left - got])
            del held[: left - got]
            digest.update(part)
            if check:
                check.update(part)
            got += len(part)
            if keep_payload:
                kept += part
        while more():
            pass
        if bytes(held) != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        whole = headers.get("warc-type") != "revisit"
        if whole and check and told.lower() != check.hexdigest() and told.upper() != base64.b32encode(check.digest()).decode():
            raise ValueError(f"payload digest of {headers.get('warc-record-id')} is wrong")
        if headers.get("warc-type") == "response" and stated is not None and not stated.isdigit():
            raise ValueError(f"payload length of {headers.get('warc-record-id')} is wrong")
        # a transfer coding may make the payload longer or shorter than its own length says
        if headers.get("warc-type") == "response" and stated is not None and int(stated) != got and "transfer-encoding" not in fields(http[1:]):
            raise ValueError(f"payload length of {headers.get('warc-record-id')} is wrong")
        size = got if whole or stated is None else int(stated)
        yield {"headers": headers, "payload_bytes": size, "payload_digest": digest.hexdigest() if whole else (told or None)} | ({"payload": bytes(kept)} if keep_payload else {})


def _page(urn: str | None):
    """The page_id in a record's name; null in names that other writers gave."""
    name = (urn or "")[len("<urn:page:") : -1]
    return int(name) if (urn or "").startswith("<urn:page:") and name.lstrip("-").isdigit() else None


def _row(r: dict) -> tuple:
    h = r["headers"]
    return _page(h.get("warc-record-id")), h.get("warc-target-uri"), r["payload_bytes"], r["payload_digest"], h.get("warc-type"), _page(h.get("warc-refers-to"))


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _told(stream: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """The records of one archive in batches of bounded size."""
    source = iter(records(stream))
    while out := [_row(r) for r in itertools.islice(source, 1000)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])


def _read(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield from _told(pieces(batch.column(0)[row].as_buffer()))


def _read_paths(batches):
    from pyarrow import fs

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as f:
                yield from _told(iter(lambda: f.read(PIECE), b""))  # noqa: B023


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(rows: DataFrame, column: str = "bytes") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives."""
    return rows.select(column).mapInArrow(_read, READ_SCHEMA)


def read_files(spark: SparkSession, path: str, streamed_from: int = 256 << 20) -> DataFrame:
    """The same from .warc.gz files. Those of `streamed_from` bytes and more are streamed by pyarrow from where they lie, smaller ones come through Spark."""
    files = spark.read.format("binaryFile").load(path)
    small = read(files.where(F.col("length") < streamed_from), "content")
    return small.unionByName(files.where(F.col("length") >= streamed_from).select("path").mapInArrow(_read_paths, READ_SCHEMA))


def round_trip(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """Writes the archives of pages to the shared folder and reads them back."""
    spark = pages.sparkSession
    at = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives(pages, least).write.parquet(at)
    return read(spark.read.parquet(at))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN coalesce(min(page_id) OVER (PARTITION BY payload_digest), page_id) ELSE page_id END AS first FROM p)
SELECT page_id, url, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f JOIN pages USING (page_id)
"""
