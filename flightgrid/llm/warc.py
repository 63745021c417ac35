"""Deterministic sharded WARC archives of pages, and their reader.

Records are range-sorted by page id; every shard is written into files of its own that
roll over at a compressed size.  The shards' bounds come from a histogram of all payload
bytes over 65,536 equal ranges of ids, and not from a sample, so that files depend on the
rows and the number of shards alone, whatever the order and the layout of the input.  Each record is a gzip member.  Headers
are made anew from the row: record ids from the page id, a fixed date, digests from
the bytes.  Of pages with equal payloads of at least ``least`` bytes the one with the
smallest id is a response and the others are revisits of it.  A file is written under
a temporary name and renamed when it is whole; its manifest row (name, records, bytes,
digest, first and last id) is committed by Spark's own protocol as a Parquet table
after all files, and readers open only what the manifest names.  A lost task writes
the same bytes under the same names again.

Defined cases: a null payload is empty and never a revisit; rows without a page id come
first, with the record id "none", and are always responses; a null url is an empty
target; control characters in urls are percent-encoded; repeated rows with the same
id and payload are all responses (or all revisits); an empty table gives an empty
manifest; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightgrid.llm._store import Files, cut, scratch_path

DATE = "2020-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    """The page id in a record id."""
    return None if name == record_id(None) else int(name[10:-1])


def _clean(url: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _b32(raw: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(raw).digest()).decode().rstrip("=")


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: {_b32(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _sharded(rows: DataFrame, n: int, ranges: int = 65_536) -> DataFrame:
    """``rows`` with their ``shard``, which holds about an ``n``-th of all bytes, sorted."""
    ends = rows.agg(F.min("page_id"), F.max("page_id")).first()
    low, step = float(ends[0] or 0), max(1.0, (float(ends[1] or 0) - float(ends[0] or 0)) / (ranges - 1))
    rows = rows.withColumn("range", F.coalesce(F.floor((F.col("page_id").cast("double") - low) / step), F.lit(-1)).cast("int"))
    held = rows.groupBy("range").agg(F.sum(F.octet_length("html") + 256).alias("bytes")).orderBy("range").collect()  # one row a range
    total, before, at = sum(r.bytes for r in held), 0, []
    for r in held:
        at.append((r.range, min(n - 1, before * n // total)))
        before += r.bytes
    shards = rows.sparkSession.createDataFrame(at, "range int, shard int")
    found = rows.join(F.broadcast(shards), "range").drop("range")
    return found.repartitionByRange(n, "shard").sortWithinPartitions("shard", "page_id", "digest", "url")


def write(pages: DataFrame, folder: str, roll: int = 256 << 20, least: int = 100, level: int = 5, most: int = 500_000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder``; the manifest, which is
    committed at ``folder``/manifest."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    # Which payload is kept where: ids and digests only.
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(first, "warc-first")
    revisit = rows.where(F.col("size") >= least).select("page_id", "digest").join(first, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct()
    revisit = cut(revisit, "warc-revisits")
    # About a hundred bytes a row: sent to all where there are few, else joined.
    small = revisit.count() <= most
    rows = rows.drop("size").join(F.broadcast(revisit) if small else revisit, ["page_id", "digest"], "left")
    rows = _sharded(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))

    listed = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        out, part, done = None, None, 0

        def close() -> pa.RecordBatch:
            out.close()
            name = f"part-{part:05d}-{done:05d}.warc.gz"
            files.rename(temp, name)
            return pa.RecordBatch.from_pylist([{"file": name, "records": count, "bytes": size, "sha256": sha.hexdigest(), "first_id": low, "last_id": high}], schema=listed)

        for batch in batches:
            for page_id, url, html, digest, refers, shard in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "shard")), strict=True):
                if shard != part:
                    if out is not None:
                        yield close()
                    out, part, done = None, shard, 0
                if out is None:
                    temp = f".{uuid.uuid4().hex}.tmp"
                    out, count, size, sha, low = files.create(temp), 0, 0, hashlib.sha256(), page_id
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = z.compress(record(page_id, url, html.encode(), digest, refers)) + z.flush()
                out.write(raw)
                sha.update(raw)
                count, size, high = count + 1, size + len(raw), page_id
                if size >= roll:
                    yield close()
                    out, done = None, done + 1
        if out is not None:
            yield close()

    rows.select("page_id", "url", "html", "digest", "first", "shard").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parse(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    z, text, rest = zlib.decompressobj(31), [], b""
    while raw := rest or f.read(1 << 20):
        text.append(z.decompress(raw))
        rest = z.unused_data
        if z.eof:
            whole = b"".join(text)
            head, _, block = whole.partition(b"\r\n\r\n")
            fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
            yield fields, block[: int(fields["Content-Length"])]
            z, text = zlib.decompressobj(31), []
    if text and b"".join(text):
        raise EOFError("the last record is cut off")


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the files in the manifest.  Sizes and digests of responses are
    taken from their bytes; revisits carry them in their headers."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[dict] = []
                held = 0
                with files.open(name) as f:
                    for h, block in parse(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        one = {"page_id": _page(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "refers_to": None}
                        declared = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if h["WARC-Type"] == "response":
                            one |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
                            if one["payload_digest"] != declared:
                                raise ValueError(f"{name}: the payload of {one['page_id']} is damaged")
                        else:
                            size = next(int(x.partition(b": ")[2]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
                            one |= {"payload_bytes": size, "payload_digest": declared, "refers_to": int(h["WARC-Refers-To"][10:-1])}
                        if payloads:
                            one["payload"] = payload
                            held += len(payload)
                        rows.append(one)
                        if len(rows) == 4096 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])])
    return manifest.select("file").repartition(n, "file").mapInArrow(run, RECORDS + ", payload binary" * payloads)


def digests(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as n, sha256(html) as h from p),
f as (select h, min(page_id) as first_ from d where n >= 100 group by h)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.h as payload_digest,
  case when f.first_ is null or d.page_id is null or f.first_ = d.page_id then 'response' else 'revisit' end as record_type,
  case when f.first_ <> d.page_id then f.first_ end as refers_to
from d left join f on d.h = f.h and d.n >= 100
"""
