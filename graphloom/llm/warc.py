"""WARC archives through a chunked record table.

Writing: payloads are cut into rows of (record, chunk, data) of a bounded size. Each task streams its rows into archives
in the shared folder, a gzip member per record, with a running digest, and starts a new archive when one is full.
Payloads that occur more than once are stored once; the others become revisit records that name it. Reading: each archive
is streamed; a record's payload comes out as rows of (record_id, chunk, data) again, with the digest and length so far.
The last chunk's are those of the whole payload, so no worker ever holds more of an oversized payload than a chunk.

Files are written under a name of the task's attempt and listed in a table. Only listed archives are read, so those of
lost or repeated attempts don't count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import ship
from graphloom.storage import materialise, scratch_path

#: Payloads below this many bytes are never replaced by a revisit.
LEAST_BYTES = 1000
#: Bytes of a chunk row.
CHUNK = 256 * 1024
#: Compressed bytes after which a new archive begins.
ARCHIVE_BYTES = 128 << 20

_CHUNK_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, refers_to long, chunk long, data binary, "
    "bytes_so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"
)
_CHUNK_COLUMNS = [c.split()[0] for c in _CHUNK_SCHEMA.split(", ")]


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of each row.

    Of equal payloads of ``least_bytes`` or more, the one with the largest page_id is stored; the others refer to it.
    Null html is an empty payload. Rows without a page_id are always stored, as are rows that repeat the largest one.
    Only digests are grouped; payloads stay where they are as long as the table of repeated digests is small, which
    Spark sees from its files. Other columns may have any names; an empty table gives no record.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = rows.where(F.col("payload_bytes") >= least_bytes)
    again = large.groupBy("payload_digest").agg(F.count("page_id").alias("n"), F.max("page_id").alias("stored"))
    again = materialise(again.where("n > 1").select(F.col("payload_digest").alias("_digest"), "stored"), "repeated")
    out = rows.join(again, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= least_bytes), "left")
    return out.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                      F.when(F.col("page_id") < F.col("stored"), F.col("stored")).alias("refers_to"))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _clean(url: str) -> str:
    """White space, control characters and non-ASCII characters percent-encoded, so that a header stays one line."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record_header(page_id, url, size: int, digest: str, refers_to, record_id: str, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    body = http_header(size) if refers_to is None else b""
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{record_name(refers_to, digest, None, None)}>",
                  f"X-Refers-To-Page-Id: {refers_to}", f"X-Payload-Length: {size}"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(body) + size if refers_to is None else 0}"]
    return "\r\n".join([*lines, "", ""]).encode() + body


def http_header(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record_name(page_id, digest: str, refers_to, url) -> str:
    """The record's id, the same in every run; rows that agree in id and payload (and url, without an id) share it."""
    name = f"none {url}" if page_id is None else f"page {page_id}"
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {digest} {'response' if refers_to is None else 'revisit'}").urn


def chunk_rows(records: DataFrame) -> DataFrame:
    """A row per chunk of each record of ``plan_records``, in order; a revisit or an empty payload is one empty chunk."""
    rows = records.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / CHUNK).cast("int") - 1)
    rows = rows.withColumn("last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last"))))
    data = F.substring("payload", F.col("chunk") * CHUNK + 1, F.lit(CHUNK))
    # Ids as text: pandas would make floats of whole numbers beside nulls.
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    return rows.select(*ids, "url", "payload_bytes", "payload_digest", "chunk", (F.col("chunk") == F.col("last")).alias("last"), data.alias("data"))


def write(records: DataFrame, path: str | None = None, date: str | None = None) -> DataFrame:
    """Write the rows of ``plan_records`` as archives below ``path``; returns the listed ones: (archive, records, bytes).

    ``date`` is the records' date, now unless given; all else in the records is the same in every run.
    """
    spark = records.sparkSession
    ship(spark)
    path = path or scratch_path(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        out, name, done, size, member, sha = None, "", 0, 0, None, None
        for pdf in parts:
            for page, refers, url, length, digest, chunk, last, data in zip(*(pdf[c] for c in pdf.columns), strict=True):
                if out is None:
                    name, done, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                if chunk == 0:
                    head = record_header(page, url, int(length), digest, refers, record_name(page, digest, refers, url), date)
                    member, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    size += out.write(member.compress(head))
                sha.update(data)
                size += out.write(member.compress(data))
                if not last:
                    continue
                if refers is None and sha.hexdigest() != digest:
                    raise ValueError(f"the payload of page {page} doesn't match its digest")
                size += out.write(member.compress(b"\r\n\r\n"))
                size += out.write(member.flush())
                done += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pd.DataFrame({"archive": [name], "records": [done], "bytes": [size]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [name], "records": [done], "bytes": [size]})

    made = chunk_rows(records).mapInPandas(run, "archive string, records long, bytes long")
    listed = materialise(made, "archives")
    return listed.withColumn("archive", F.concat(F.lit(f"{path}/"), "archive"))


def _members(stream) -> Iterator[tuple[str, bytes]]:
    """("data", bytes) as a gzip file of many members is inflated, ("end", b"") after each member."""
    inflate, rest = zlib.decompressobj(31), b""
    while True:
        data = rest or stream.read(CHUNK)
        if not data:
            return
        got = inflate.decompress(data, CHUNK)
        if got:
            yield "data", got
        if inflate.eof:
            yield "end", b""
            rest, inflate = inflate.unused_data, zlib.decompressobj(31)
        else:
            rest = inflate.unconsumed_tail


def records_of(stream) -> Iterator[tuple]:
    """The chunk rows of an archive. A record without payload gives one row with an empty chunk."""
    head, fields, left, sha, size, chunk, held, wrapped = bytearray(), None, 0, None, 0, 0, bytearray(), False

    def row(data: bytes, last: bool) -> tuple:
        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
        total = int(fields.get("x-payload-length", size)) if last else None
        whole = fields["warc-payload-digest"].removeprefix("sha1:") if refers is not None else sha.hexdigest()
        return (fields["warc-record-id"].strip("<>"), page and int(page), fields.get("warc-target-uri"), fields["warc-type"],
                refers and int(refers), chunk, data, size, sha.hexdigest(), last, total, whole if last else None)

    for kind, data in _members(stream):
        if kind == "end":
            if fields is None:
                raise ValueError("a record without a header")
            if left:
                raise ValueError(f"record {fields['warc-record-id']} lacks {left} bytes")
            sha.update(held)
            size += len(held)
            last = row(bytes(held), True)
            if fields["warc-type"] != "revisit" and last[-1] != fields["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"record {fields['warc-record-id']} doesn't match its digest")
            yield last
            head, fields, held = bytearray(), None, bytearray()
            continue
        if fields is None:
            head += data
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            lines = bytes(head[:end]).decode().split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
            left, sha, size, chunk = int(fields["content-length"]), hashlib.sha1(), 0, 0
            wrapped = left > 0 and fields.get("content-type", "").startswith("application/http")
            data = bytes(head[end + 4 :])
        take, left = data[:left], left - min(left, len(data))
        held += take
        if wrapped:  # the payload begins behind the message's own header
            end = held.find(b"\r\n\r\n")
            if end < 0:
                continue
            del held[: end + 4]
            wrapped = False
        while len(held) > CHUNK:
            part = bytes(held[:CHUNK])
            del held[:CHUNK]
            sha.update(part)
            size += len(part)
            yield row(part, False)
            chunk += 1


def read(archives: DataFrame) -> DataFrame:
    """The chunk table of the listed archives: a row per record and chunk, in order within a record.

    record_id, page_id, url, record_type, refers_to, chunk, data, bytes_so_far, digest_so_far, last; payload_bytes and
    payload_digest on the last chunk (for a revisit, those of the payload that it refers to). Damaged records raise.
    """
    ship(archives.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for uri in pdf["archive"]:
                fs, name = _filesystem(uri)
                out, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for r in records_of(stream):
                        out.append(r)
                        held += len(r[6])
                        if held >= 16 * CHUNK or len(out) >= 2000:
                            yield _chunks(out)
                            out, held = [], 0
                yield _chunks(out)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n, "archive").mapInPandas(run, _CHUNK_SCHEMA)


def _chunks(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_CHUNK_COLUMNS, dtype=object)
    return out.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes", "bytes_so_far", "chunk")})


def summary(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk."""
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
