"""WARC archives with an index first: offset, length, URL and digest of each record are known as it is written, and reads
go by the index, coalesced into sorted byte ranges.

Each task writes one gzip member per record into an archive of its own (named with a fresh id, so a retried or speculative
task never touches another's file) and returns the index rows; the index, kept as Parquet, names only archives of tasks that
succeeded. Reading deals the selected index rows by archive and stretch, sorts them, and joins neighbouring records into one
read of at most ``RANGE_BYTES`` (a single longer record is one read).

Equal payloads (same SHA-1 and length): the smallest id is the response, the others revisit it, without the payload. The
groups are found on digests and ids alone; the payloads are dealt once, by id and digest, evenly whatever the groups' sizes
(rows equal in id and payload stay together).

Defined cases: null payloads are empty; a null URL is written as an empty one and read as null; a null id never is a group's
response unless all its ids are null; rows that share the smallest id are all responses; an empty table writes no record.
Only the named columns are read. Files go to the shared folder through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20
STRETCH_BYTES = 32 << 20
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
_INDEX_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + c.flush()


def parse(member: bytes) -> dict:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda urn: int(urn[10:-1]) if urn[10:-1] else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (digest_of(body) != digest or len(body) != int(fields["X-Payload-Length"])):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload doesn't have its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"] or None, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else body}


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the archives under ``folder``; the index, as read back from its own table beside them."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    narrow = rows.groupBy("page_id", "sha", "size").agg(F.count(F.lit(1)).alias("n"))  # one row for each of a page's payloads
    groups = narrow.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    decided = narrow.drop("n").join(groups, ["sha", "size"]).withColumnsRenamed({"page_id": "i", "sha": "s", "size": "z"})
    same = F.col("page_id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z"))
    rows = rows.join(decided, same, "left")  # payloads are dealt by id, so that copies spread
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "url", "payload", "first", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, name, offset = None, None, "", 0
        try:
            for batch in batches:
                index = []
                for r in batch.to_pylist():
                    if out is None:
                        files, place = pafs.FileSystem.from_uri(folder)
                        files.create_dir(place, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{place}/{name}", compression=None)
                    digest = digest_of(r["payload"])
                    member = record(r["page_id"], r["url"], r["payload"], digest, r["first"], r["revisit"])
                    out.write(member)
                    index.append((name, offset, len(member), r["url"], digest, r["page_id"], "revisit" if r["revisit"] else "response", r["first"] if r["revisit"] else None))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in index], f.type) for i, f in enumerate(_INDEX_ARROW)], schema=_INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Sorted (offset, length) records as reads: (first, last + 1, start, end); records that touch share a read."""
    i = 0
    while i < len(rows):
        j, start, end = i + 1, rows[i][0], sum(rows[i])
        while j < len(rows) and rows[j][0] <= end and sum(rows[j]) - start <= RANGE_BYTES:
            end = max(end, sum(rows[j]))
            j += 1
        yield i, j, start, end
        i = j


def read(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows select, read back from the archives and checked against their digests."""
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    rows = index.select("archive", "offset", "length", stretch.alias("s")).repartition("archive", "s").sortWithinPartitions("archive", "offset").drop("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            a, o, n = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(a):
                j = i
                while j < len(a) and a[j] == a[i]:
                    j += 1
                with files.open_input_file(f"{place}/{a[i]}") as f:
                    for x, y, start, end in ranges(list(zip(o[i:j], n[i:j]))):
                        data = f.read_at(end - start, start)
                        yield pa.RecordBatch.from_pylist([parse(data[o[i + k] - start : o[i + k] - start + n[i + k]]) for k in range(x, y)], schema=_RECORDS_ARROW)
                i = j

    return rows.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
