"""WARC archives: written with an index first, read by coalesced byte ranges.

Each task appends its records to an archive of its own in the shared folder,
one gzip member a record, and returns an index row for each: archive, offset,
length, URL and payload digest. The index is stored before anything is read.
A reader selects records from it, sorts them by archive and offset, joins
neighbouring ranges and reads each range at once. Archives are named by task
attempt and known through the index alone, so what a lost task left is ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, place: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; its id comes from its place in an archive. A revisit holds the HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = uuid.UUID(bytes=hashlib.md5(place.encode()).digest())
    clean = "" if url is None else "".join(c if c.isprintable() and c != " " else "%%%02X" % (ord(c) & 255) for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode("utf-8", "replace") + _END + block + _END


def parsed(raw: bytes) -> tuple:
    """The columns of RECORD from one record."""
    head, _, rest = raw.partition(_END)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_END)
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind = fields["WARC-Type"]
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-ID"), fields["WARC-Target-URI"], kind, number("X-Refers-To-Page-ID"), size, fields["WARC-Payload-Digest"].removeprefix("sha256:"), payload if kind == "response" else None


def write(pages: DataFrame, path: str, min_bytes: int = 100, level: int = 4) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) under path and returns the stored index.

    Of rows with equal payloads of at least min_bytes bytes, the one with the
    smallest page_id is a response and the others revisit it; all smaller
    payloads are responses. Ties go to the smaller URL (null is the empty one);
    of rows that repeat whole, one is the response. A row without page_id comes
    after all others, and is a response only if no row with an id has its
    payload. A null html is the empty payload; payloads of any length are
    written whole; other columns are not looked at; an empty table gives an
    empty index.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # short payloads never meet: their keys equal no digest, and spread them
    large = F.octet_length("payload") >= min_bytes
    rows = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("link").alias("url"), "copies")
    each = rows.where(large).groupBy("digest", "page_id", F.coalesce("url", F.lit("")).alias("link")).agg(F.count("*").alias("copies"))
    again = each.groupBy("digest").agg(F.min(place).alias("first"), F.sum("copies").alias("n")).where("n > 1").withColumnRenamed("digest", "same")
    again = common.stored(again, "warc-again")
    joined = common.split_join(rows, again, [("key", "same")], "n", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.coalesce("url", F.lit("")) == F.col("first.url"))
    revisit = F.col("first").isNotNull() & ~F.coalesce(is_first, F.lit(False))
    refers = F.when(revisit, F.col("first.page_id"))
    marked = joined.withColumns({"revisit": revisit, "refers_to": refers, "copies": F.when(~revisit, F.col("first.copies"))})
    columns = ["page_id", "url", "payload", "digest", "revisit", "refers_to"]
    if again.where("first.copies > 1").limit(1).count():
        # rows that repeat whole can't be told apart: they are counted, and written as one response and revisits
        tied = marked.where("copies > 1").groupBy("page_id", F.coalesce("url", F.lit("")).alias("url"), "digest").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
        tied = tied.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("revisit", F.col("nth") > 1)
        tied = tied.withColumn("refers_to", F.when(F.col("revisit"), F.col("page_id")))
        marked = marked.where("copies is null or copies = 1").select(*columns).unionByName(tied.select(*columns))
    marked = marked.select(*columns)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, at, name = TaskContext.get(), None, 0, ""
        store, top = fs.FileSystem.from_uri(path)
        try:
            for batch in batches:
                index = []
                for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if out is None:
                        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                        store.create_dir(top, recursive=True)
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    page_id, url, payload, digest, revisit, refers_to = r
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = member.compress(record(page_id, url, f"{name} {at}", payload, digest, refers_to, revisit)) + member.flush()
                    out.write(data)
                    index.append((f"{path}/{name}", at, len(data), page_id, url, digest, "revisit" if revisit else "response"))
                    at += len(data)
                columns = list(zip(*index, strict=True)) if index else [()] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["archive", "offset", "length", "page_id", "url", "payload_digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return common.stored(marked.mapInArrow(archive, INDEX), "warc-index")


def read(index: DataFrame, gap: int = 1 << 16, most: int = 1 << 23, split: int = 1 << 22) -> DataFrame:
    """The records (see RECORD) that index selects. Ranges at most `gap` bytes apart are read together, up to about `most` bytes at once.

    An archive is read by several tasks, one for about each `split` bytes that are selected.

    A revisit has the payload's size and digest and the page it refers to, but
    a null payload; a URL comes back with blanks and control characters escaped.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    chosen = index.select("archive", "offset", "length").repartition(max(1, -(-total // split)), "archive", F.floor(F.col("offset") / split)).sortWithinPartitions("archive", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            ranges: list[tuple[str, int, int, list[tuple[int, int]]]] = []
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ranges and ranges[-1][0] == archive and offset - ranges[-1][2] <= gap and offset + length - ranges[-1][1] <= most:
                    _, first, end, parts = ranges[-1]
                    parts.append((offset, length))
                    ranges[-1] = (archive, first, max(end, offset + length), parts)
                else:
                    ranges.append((archive, offset, offset + length, [(offset, length)]))
            for archive, first, end, parts in ranges:
                if archive != name:
                    if source is not None:
                        source.close()
                    store, where = fs.FileSystem.from_uri(archive)
                    name, source = archive, store.open_input_file(where)
                data = source.read_at(end - first, first)
                rows = [parsed(zlib.decompress(data[o - first : o - first + n], 31)) for o, n in parts]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        if source is not None:
            source.close()

    return chosen.mapInArrow(fetch, RECORD)


def digest(pages: DataFrame) -> DataFrame:
    """Archives all pages, reads all records back and returns page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are taken anew from the payload that was read.
    """
    index = write(pages, common.shared_dir(pages.sparkSession, "warc"))
    held = F.col("record_type") == "response"
    return read(index).select(
        "page_id",
        F.when(held, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(held, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
