"""WARC archives, index first.

Writing: each task writes its records to archives of its own, one gzip member
per record, and gives one index row per record: file, offset, length, URL and
digest. The index is what commits: a task that is run again writes new files,
and files no index row names are not part of the archive. Reading: the selected
index rows are brought together by file and sorted by offset, neighbouring
ranges are read at once, and each record is cut out and checked by its digest.

Of records with equal payloads of at least ``least_payload`` bytes, that with the
largest id is a response; the others are revisits that name it and hold the HTTP
header block alone. The digest of a payload is its SHA-1 in base 32.

Defined results: a null payload is empty; a record without a URL has no URL
field and is read back as null, an empty one as empty; line ends in a URL are
percent-encoded; very long payloads are written whole; an empty table gives an
empty index; null ids are records like others and never chosen before one with
an id; rows that repeat the largest id of their payload are responses each; other
columns are not written. Archives lie under a folder the cluster shares. A folder
without a scheme is where Hadoop's default file system has it; Arrow's file
systems open it in the tasks (mounted paths, S3, GCS, HDFS with libhdfs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from playframe.llm.common import Scratch, batch_of, qualified, spread_join

DATE = "2000-01-01T00:00:00Z"
ID = "<urn:x-page:{}>"
INDEX = "file string, offset long, length long, url string, digest string"


@dataclass(frozen=True)
class Warc:
    least_payload: int = 0
    archive_bytes: int = 256 << 20   # an archive is closed beyond it
    level: int = 3
    gap: int = 64 << 10              # bytes between records that are read along
    run: int = 8 << 20               # most bytes of one read
    range_bytes: int = 32 << 20      # of an archive that one task reads in order


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's UTF-8 bytes in upper-case base 32."""
    digest = F.sha1(payload)
    parts = [F.translate(F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0"),
                         "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for i in range(8)]
    return F.concat(*parts)


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """The bytes of a record; a revisit where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", ID.format(name))]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", ID.format(refers_to)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields in lower case, the HTTP header and the payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        fields[k.lower()] = v
    block = rest[: int(fields["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload": payload, "size": size}


def _open(folder: str):
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder[5:]  # as Hadoop writes a local path
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _page(name: str | None) -> int | None:
    text = (name or "")[len(ID.format("")) - 1:-1]
    return None if text in ("", "null") else int(text)


def write(pages: DataFrame, folder: str, scratch: Scratch, opt: Warc = Warc()) -> DataFrame:
    """Write a record per row (page_id, url, html); the index table."""
    folder = qualified(pages.sparkSession, folder)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"))
    keyed = rows.select("page_id", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    keyed = scratch.keep(keyed)
    first = keyed.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    revisit = (spread_join(keyed.filter(F.col("size") >= opt.least_payload), first, "digest", ["page_id"])
               .filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct())
    marked = rows.withColumn("digest", base32_sha1(F.col("html"))).alias("p").join(
        revisit.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest")), "left")
    marked = marked.select("p.page_id", "p.url", F.when(F.col("r.first").isNull(), F.col("p.html")).otherwise("").alias("html"),
                           "p.digest", "r.first", F.octet_length("p.html").cast("long").alias("size"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index: dict[str, list] = {"file": [], "offset": [], "length": [], "url": [], "digest": []}
                for r in batch.to_pylist():
                    if out is None or at >= opt.archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    raw = gzip.compress(record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["digest"],
                                               r["first"], r["size"]), opt.level, mtime=0)
                    out.write(raw)
                    for k, v in zip(index, (name, at, len(raw), r["url"], r["digest"]), strict=True):
                        index[k].append(v)
                    at += len(raw)
                yield batch_of(file=pa.array(index["file"], pa.string()), offset=pa.array(index["offset"], pa.int64()),
                               length=pa.array(index["length"], pa.int64()), url=pa.array(index["url"], pa.string()),
                               digest=pa.array(index["digest"], pa.string()))
        finally:
            if out is not None:
                out.close()

    index = scratch.keep(marked.mapInArrow(put, INDEX))
    scratch.drop(keyed)
    return index


def ranges(rows: list[tuple[int, int]], opt: Warc) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) rows joined to reads: (first row, end row, start, end)."""
    out, i = [], 0
    while i < len(rows):
        start, end, j = rows[i][0], rows[i][0] + rows[i][1], i + 1
        while j < len(rows) and rows[j][0] - end <= opt.gap and rows[j][0] + rows[j][1] - start <= opt.run:
            end = max(end, rows[j][0] + rows[j][1])
            j += 1
        out.append((i, j, start, end))
        i = j
    return out


def read(index: DataFrame, folder: str, opt: Warc = Warc()) -> DataFrame:
    """The records of the index rows: page_id, url, record_type, refers_to,
    payload_digest, payload_bytes and payload (null for a revisit)."""
    folder = qualified(index.sparkSession, folder)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name, source = None, None
        for batch in batches:
            files, rows = batch.column("file").to_pylist(), list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            a = 0
            while a < len(files):
                b = a
                while b < len(files) and files[b] == files[a]:
                    b += 1
                if files[a] != name:
                    if source is not None:
                        source.close()
                    name, source = files[a], system.open_input_file(f"{root}/{files[a]}")
                for i, j, start, end in ranges(rows[a:b], opt):
                    raw = source.read_at(end - start, start)
                    yield _records(raw, start, rows[a + i:a + j])
                a = b
        if source is not None:
            source.close()

    # index rows are few bytes and many reads: the number of tasks follows the archives, not the rows
    spark = index.sparkSession
    whole = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * -(-whole // opt.range_bytes))
    placed = index.select("file", "offset", "length").withColumn("range", F.expr(f"offset div {opt.range_bytes}"))
    placed = placed.repartition(tasks, "file", "range").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return placed.mapInArrow(get, "page_id long, url string, record_type string, refers_to long, payload_digest string, "
                                  "payload_bytes long, payload string")


def _records(raw: bytes, start: int, rows: list[tuple[int, int]]) -> pa.RecordBatch:
    out: dict[str, list] = {k: [] for k in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")}
    for offset, length in rows:
        r = parse(zlib.decompress(raw[offset - start:offset - start + length], 31))
        f, payload, size, digest = r["fields"], r["payload"], r["size"], r["fields"]["warc-payload-digest"].removeprefix("sha1:")
        kind = f["warc-type"]
        if kind == "response":
            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            if f["warc-payload-digest"] != f"sha1:{digest}" or size != r["size"]:
                raise ValueError(f"payload of {f['warc-record-id']} differs from its digest")
        for k, v in zip(out, (_page(f["warc-record-id"]), f.get("warc-target-uri"), kind, _page(f.get("warc-refers-to")), digest, size,
                              payload.decode("utf-8", "surrogatepass") if kind == "response" else None), strict=True):
            out[k].append(v)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return batch_of(**{k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


def round_trip(pages: DataFrame, opt: Warc = Warc()) -> DataFrame:
    """Write all pages under the shared folder and read all of them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.root}/archives"
    return read(write(pages, folder, scratch, opt), folder, opt)
