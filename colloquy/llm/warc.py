"""WARC archives: write them as whole-file gzip streams, normalise those, and read them back.

A monolithic gzip archive is one member, so nothing in it can be reached without inflating all
before it. The normaliser inflates such a stream once, rewrites every record as a gzip member of
its own, and writes a sidecar index of offsets. Readers then open single records by offset.

Archives are rows of a table in the shared folder (name, bytes), so they live in whatever store
Spark writes to. A task starts a new archive after ``archive_bytes`` of records; an archive is
thus bounded by that and one record, whatever the input.

Of pages with equal payloads of at least ``least_bytes``, those with the smallest page_id are
written as responses; the others are revisits that refer to it and hold no payload.

Defined results: a null html is an empty payload; rows that repeat the smallest page_id with its
payload are all responses; a null page_id never is referred to, and revisits if another page has
its payload; a null url is left out; other columns are ignored; an empty table gives no archive; a html of any length is
one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import map_batches, sliced, written

END = b"\r\n\r\n"
#: Records carry no clock time, so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, data binary"
INDEXED = "archive string, data binary, sidecar array<struct<offset: long, length: long, record_id: string>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long"


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return None if tail in ("", "none") else int(tail)


def header_value(text: str) -> str:
    """A header value can't hold line ends."""
    return "".join("%%%02X" % ord(c) if ord(c) < 32 or ord(c) == 127 else c for c in text)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", header_value(url))] if url else []),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        *([("WARC-Refers-To", page_urn(refers_to)), ("WARC-Profile", PROFILE)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at ``at``."""
    head_end = data.index(END, at)
    first, *lines = data[at:head_end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    start = head_end + len(END)
    end = start + int(fields["Content-Length"])
    if data[end : end + len(END)] != END:
        raise ValueError(f"the record at byte {at} is cut off")
    return fields, data[start:end], end + len(END)


def with_originals(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and the page that a revisit refers to (null for responses)."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    first = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    repeated = first.where("n > 1 AND original IS NOT NULL").select("sha", "original")
    other = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("original")), F.col("original"))
    return rows.join(repeated, "sha", "left").select("page_id", "url", "html", F.when(F.col("original").isNotNull(), other).alias("refers_to"))


def write_archives(pages: DataFrame, *, archive_bytes: int = 8_000_000, level: int = 1) -> DataFrame:
    """Monolithic gzip archives of rows (page_id, url, html, refers_to)."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size, parts = TaskContext.get().partitionId(), 0, 0, []
        packer = zlib.compressobj(level, wbits=31)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join([*parts, packer.flush()])], pa.binary())], ["archive", "data"])

        for batch in sliced(batches, 256):
            for row in batch.to_pylist():
                raw = record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"])
                parts.append(packer.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
                    n, size, parts, packer = n + 1, 0, [], zlib.compressobj(level, wbits=31)
        if size:
            yield close()

    return pages.mapInArrow(write, ARCHIVES)


def normalise(archives: DataFrame, *, level: int = 6) -> DataFrame:
    """Archives with one gzip member per record, and their sidecar indexes."""

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, sidecars = [], []
        for data in batch["data"].to_pylist():
            stream = zlib.decompressobj(wbits=31)
            raw = stream.decompress(data) + stream.flush()
            if not stream.eof or stream.unused_data:
                raise ValueError("not one whole gzip member")
            members, index, at, offset = [], [], 0, 0
            while at < len(raw):
                fields, _, end = parse(raw, at)
                member = gzip.compress(raw[at:end], level, mtime=0)
                index.append({"offset": offset, "length": len(member), "record_id": fields["WARC-Record-ID"]})
                members.append(member)
                at, offset = end, offset + len(member)
            out.append(b"".join(members))
            sidecars.append(index)
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]))
        return pa.RecordBatch.from_arrays([batch["archive"], pa.array(out, pa.binary()), pa.array(sidecars, kind)], ["archive", "data", "sidecar"])

    return map_batches(archives, rewrite, INDEXED, rows=1)


def read_records(normalised: DataFrame) -> DataFrame:
    """Every record, opened by the sidecar's offsets; digests of payloads held are verified."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for archive, data, sidecar in zip(*(batch[c].to_pylist() for c in ("archive", "data", "sidecar")), strict=True):
            for entry in sidecar:
                raw = gzip.decompress(data[entry["offset"] : entry["offset"] + entry["length"]])
                fields, block, _ = parse(raw, 0)
                if fields["WARC-Record-ID"] != entry["record_id"]:
                    raise ValueError(f"the index of {archive} is wrong at {entry['offset']}")
                http, _, payload = block.partition(END)
                size = int(http.decode().rpartition("Content-Length: ")[2])
                sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha):
                    raise ValueError(f"a payload in {archive} doesn't have its digest")
                rows.append((page_of(entry["record_id"]), size, sha, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), archive, entry["offset"], entry["length"]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in RECORDS.split(", ")])

    return map_batches(normalised, read, RECORDS, rows=1)


def warc_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = 8_000_000) -> DataFrame:
    """Write, normalise and read back: one row per page."""
    rows = with_originals(pages, id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes)
    archives = written(write_archives(rows, archive_bytes=archive_bytes), "warc-whole")
    return read_records(written(normalise(archives), "warc"))
