"""WARC archives: one gzip member per record, a sequential reader with incremental inflation.

Payloads are deduplicated by digest before writing: of records with equal payloads the one with the smallest id is a response, the others are
revisits that name it and keep its HTTP head without the payload.  Every task writes one archive.  The reader inflates member after
member from a stream, frames each record by its content-length, recomputes block and payload digests and raises ValueError on damage.

Defined cases: a null payload is an empty one; a null url is left out; characters of a url that a header can't hold are percent-encoded; of
rows that repeat id and payload all are responses if that id is the smallest; a null id is never referred to, and is a response if all ids with its
payload are null. Payloads under `least` bytes are always responses. An empty table gives no records. Other columns are ignored. Records that the
reader meets in others' archives may lack digests and HTTP heads (warcinfo, request, metadata); their payload is the block, or what follows an HTTP head.
A record is held in memory whole, twice while it is inflated.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import filesystem, publish, scratch, slices, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16


class Record(NamedTuple):
    """offset: of the gzip member in the archive. size: of the full payload, also where a revisit leaves it out."""

    offset: int
    kind: str
    record_id: str
    uri: str | None
    refers_to: str | None
    digest: str
    size: int
    payload: bytes


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member: a response, or a revisit if refers_to is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=chr(37) + ':/?#[]@!$&()*+,;=~' + chr(39))}")
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Block-Digest: sha1:{sha1(block)}", f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream, step: int = STEP) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream, inflated piece by piece."""
    at, data = 0, stream.read(step)
    while data:
        z, parts, begin = zlib.decompressobj(31), [], at
        while not z.eof:
            if not data:
                raise ValueError(f"the member at {begin} is cut off")
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise ValueError(f"the member at {begin} is damaged: {e}") from e
            at += len(data) - len(z.unused_data)
            data = z.unused_data if z.eof else stream.read(step)
        yield begin, b"".join(parts)
        data = data or stream.read(step)


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line without a colon continues none and is left out."""
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, colon, v in pairs if colon}


def _size(fields: dict[str, str], offset: int) -> int | None:
    told = fields.get("content-length")
    if told is not None and not (told.isascii() and told.isdigit()):
        raise ValueError(f"the length at {offset} is no number")
    return None if told is None else int(told)


def _verify(digest: str | None, data: bytes, message: str) -> None:
    """SHA-1 digests are checked; one that is absent, or of another algorithm, says nothing here."""
    if digest is not None and digest.lower().startswith("sha1:") and digest[5:].upper() != sha1(data):
        raise ValueError(message)


def read(stream) -> Iterator[Record]:
    """All records of an archive, of any type, verified by the lengths and SHA-1 digests that they state; ValueError on damage."""
    for offset, data in members(stream):
        cut = data.find(b"\r\n\r\n")
        if cut < 0 or not data.startswith(b"WARC/1."):
            raise ValueError(f"no record head at {offset}")
        f = _fields(data[:cut].split(b"\r\n")[1:])
        size = _size(f, offset)
        if not {"warc-type", "warc-record-id"} <= f.keys() or size is None:
            raise ValueError(f"the record at {offset} lacks its type, id or length")
        block = data[cut + 4 : cut + 4 + size]
        if len(block) != size or data[cut + 4 + size :] != b"\r\n\r\n":
            raise ValueError(f"the record at {offset} isn't as long as its head says")
        _verify(f.get("warc-block-digest"), block, f"the block digest at {offset} is wrong")
        kind, payload, full = f["warc-type"], block, size
        if f.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            if cut < 0:
                raise ValueError(f"no end of the HTTP head at {offset}")
            payload = block[cut + 4 :]
            told = _size(_fields(block[:cut].split(b"\r\n")[1:]), offset)
            full = len(payload) if told is None else told
        if kind != "revisit":  # a revisit's digest is that of the payload it leaves out
            if len(payload) != full:
                raise ValueError(f"the payload at {offset} isn't as long as its head says")
            _verify(f.get("warc-payload-digest"), payload, f"the payload digest at {offset} is wrong")
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or sha1(payload)
        refers = f.get("warc-refers-to")
        yield Record(offset, kind, f["warc-record-id"].strip("<>"), f.get("warc-target-uri"), refers and refers.strip("<>"), digest, full, payload)


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _page(urn: str | None) -> int | None:
    last = (urn or "").rpartition(":")[2]
    return int(last) if last else None


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the archives into a shared folder; path and records of each."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col), "utf-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= least
    firsts = p.select("id", "digest", long.alias("long")).where("long").groupBy("digest").agg(F.min("id").alias("response")).withColumnRenamed("digest", "first_digest")
    # Equal payloads may be a third of all rows: an outer join that AQE splits where it is skewed.
    p = p.join(firsts, (F.col("digest") == F.col("first_digest")) & long, "left")
    p = p.select("id", "url", "payload", F.when(F.col("id").isNull() | (F.col("id") > F.col("response")), F.col("response")).alias("refers"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = slices(batches, "payload")
        first = next(batches, None)
        if first is None:
            return
        store, top = filesystem(folder)
        name, done = f"part-{TaskContext.get().partitionId():06d}.warc.gz", [0]

        def write(out) -> None:
            b = first
            while b is not None:
                done[0] += b.num_rows
                for row in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "refers")), strict=True):
                    out.write(record(_urn(row[0]), row[1], row[2], None if row[3] is None else _urn(row[3])))
                b = next(batches, None)

        publish(store, f"{top}/{name}", write)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array(done, pa.int64())], ["path", "records"])

    made = p.mapInArrow(work, "path string, records long")
    made.write.parquet(f"{folder}/_files")
    return spark.read.schema(made.schema).parquet(f"{folder}/_files")


RECORD = "page_id long, offset long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives that `files` lists by path, verified; payload is null unless wanted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for r in read(stream):
                        rows.append((_page(r.record_id), r.offset, r.kind, r.uri, _page(r.refers_to), r.digest, r.size, r.payload if payloads else None))
                        held += len(r.payload) * payloads + 200
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    # A stated number of partitions: adaptive execution would join them, as it sees the paths' few bytes and not the archives'.
    return files.select("path").repartition(max(1, files.count()), F.col("path")).mapInArrow(work, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS m FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(x)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)
    for v in [CAST('0x' || substr(h, i, 5) AS INTEGER) for i in range(1, 41, 5)]], '') AS payload_digest,
  CASE WHEN page_id > m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > m THEN m END AS refers_to
FROM p JOIN f USING (h)
"""
