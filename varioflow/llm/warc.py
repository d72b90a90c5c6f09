"""WARC archives of page captures: writing, reading, and transaction assembly.

A capture is three records: the request, the response (or, where an equal
payload is archived under a smaller id, a revisit that names that page's url and
date), and metadata; the first and the last name the second in
WARC-Concurrent-To.  Records go out through Spark's text writer, whose line
separator is the two line ends that close a record, so files are committed,
retried and compressed as any other output and land wherever Spark can write.
Archives are read as whole files, so their payload bytes are bounded: pages far
beyond the mean are archived in files of fewer records.  The records are joined
through the concurrent-to identifiers to one nested row per capture.

Defined results: a null html is an empty payload, a null url leaves the target
out; of rows that repeat the smallest id of a payload all are responses, other
repeated rows are all revisits; rows with a null page_id are responses only if
no row with an id has their payload; line breaks in a url come back
percent-encoded; an empty table writes an archive without records; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

END = "\r\n"
BETWEEN = END * 2
#: Payload bytes that an archive file holds at most (a larger page has a file of its own), which bounds a reading task.
BYTES_PER_FILE = 256 << 20
#: Pages up to so many times the mean are archived together, larger ones apart, in files of fewer records.
COMMON, STEP = 32, 8
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times ten hex digits to eight letters."""
    digest = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*fives)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest, bytes, first, first_url``: of the page that a revisit refers to, else null.

    Only ids, urls and digests meet by digest, where a payload may be very
    frequent; the payloads are joined to the outcome by id.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    marks = rows.select("page_id", "url", "digest", "bytes").where(F.col("bytes") >= least_bytes)
    found = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    least = marks.groupBy("digest").agg(found.alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", F.col("first")["page_id"].alias("first"), F.col("first")["url"].alias("first_url"))
    later = marks.join(least, "digest").where("page_id is null or page_id > first").select(F.col("page_id").alias("own"), F.col("digest").alias("own_digest"), "first", "first_url").distinct()
    # one plan at every size: pages are dealt by id, and so many bytes of them are exchanged, whether few or many repeat
    met = rows.join(later.hint("merge"), F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest")), "left")
    return met.select("page_id", "url", "html", "digest", "bytes", "first", "first_url")


def _id(kind: str) -> Column:
    # the row's number makes repeated rows distinct; a rerun task rewrites its whole file
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col("page_id").cast("string"), F.col("digest"), F.col("__row").cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _target(url: str) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def _record(kind: Column | str, own: Column, block: Column, media: str, extra: list[tuple[str, Column]]) -> Column:
    fields = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", own), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", _target("url")), *extra, ("Content-Type", F.lit(media)), ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat_ws(END, F.lit("WARC/1.1"), *[F.when(v.isNotNull(), F.concat(F.lit(k + ": "), v)) for k, v in fields])
    return F.concat(head, F.lit(BETWEEN), block)


def sizes(pages: DataFrame, html: str) -> list[tuple[int, int]]:
    """(most payload bytes of a page, captures that a file may hold), from common pages to the largest."""
    r = pages.agg(F.avg(F.octet_length(html)).alias("mean"), F.max(F.octet_length(html)).alias("most")).first()
    bounds = [max(int(COMMON * (r["mean"] or 0)), 1 << 12)]
    while bounds[-1] < (r["most"] or 0):
        bounds.append(bounds[-1] * STEP)
    return [(b, max(1, BYTES_PER_FILE // b)) for b in bounds]


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, records_per_file: int | None = None, compression: str = "gzip") -> None:
    """Archive the pages under ``path``; ``records_per_file`` bounds a file further."""
    rows, low = captures(pages, page_id, url, html, least_bytes), -1
    for most, count in sizes(pages, html):
        own = between(rows, low, most)
        limit = min(3 * count, records_per_file or 3 * count)
        _records(own).write.mode("append").option("lineSep", BETWEEN).option("compression", compression).option("maxRecordsPerFile", limit).text(path)
        low = most


def between(rows: DataFrame, low: int, most: int) -> DataFrame:
    """The captures of a band of sizes, numbered only then: the filter goes below the join, so that a band exchanges its own pages alone."""
    return rows.where((F.col("bytes") > low) & (F.col("bytes") <= most)).withColumn("__row", F.monotonically_increasing_id())


def _records(rows: DataFrame) -> DataFrame:
    """``value``: request, response or revisit, and metadata of each capture."""
    rest = F.coalesce(F.regexp_extract("url", r"(?s)://([^\s/?#]*)([^\s#]*)", 2), F.lit(""))
    host = F.coalesce(F.regexp_extract("url", r"://([^\s/?#]*)", 1), F.lit(""))
    main, revisit = _id("response"), F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(BETWEEN))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    request = _record("request", _id("request"), F.concat(F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(BETWEEN)), "application/http; msgtype=request", [("WARC-Concurrent-To", main)])
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        main,
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
        "application/http; msgtype=response",
        [("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To-Target-URI", F.when(revisit, _target("first_url"))), ("WARC-Refers-To-Date", F.when(revisit, F.lit(DATE)))],
    )
    facts = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit("")), F.coalesce(F.concat(F.lit("refers-to-page: "), F.col("first").cast("string"), F.lit(END)), F.lit("")), F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(END))
    metadata = _record("metadata", _id("metadata"), facts, "application/warc-fields", [("WARC-Concurrent-To", main)])
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


RECORD = "record_id string, type string, target string, concurrent_to string, digest string, profile string, block_bytes long, payload_bytes long, payload_sha1 string, fields map<string,string>, payload binary"


def parsed(raw: bytes):
    """The records of an archive: (header fields by lower-cased name, block)."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        yield head, raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record not closed at byte {at}")
        at += 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; payload sizes and digests are those of the bytes found."""

    def rows(batches):
        kind = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target", pa.string()), ("concurrent_to", pa.string()), ("digest", pa.string()), ("profile", pa.string()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                held, size = [], 0
                for head, block in parsed(raw):
                    payload, fields = None, None
                    if head["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                    elif head["warc-type"] == "metadata":
                        fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if ": " in x]
                    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None
                    held.append((head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("warc-concurrent-to"), (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, head.get("warc-profile"), len(block), None if payload is None else len(payload), sha1, fields, payload if payloads else None))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: page_id, main record, request and metadata nested."""
    main = records.where("type in ('response', 'revisit')").select("record_id", "target", F.struct("type", "digest", "profile", "payload_bytes", "payload_sha1", "payload").alias("main"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "block_bytes").alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "fields").alias("metadata"))
    met = main.join(request.hint("merge"), "record_id", "left").join(metadata.hint("merge"), "record_id", "left")
    fields = F.col("metadata")["fields"]
    return met.select(fields["page-id"].cast("long").alias("page_id"), fields["payload-bytes"].cast("long").alias("declared_bytes"), fields["refers-to-page"].cast("long").alias("refers_to"), "record_id", "target", "main", "request", "metadata")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back and assemble the captures."""
    path = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(C.table(spark, sf_dir, "pages"), path)
    out = assemble(C.stored(read(spark, path, payloads=False).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "records"))
    main = F.col("main")
    return out.select(
        "page_id",
        F.coalesce(main["payload_bytes"], "declared_bytes").alias("payload_bytes"),
        F.coalesce(main["payload_sha1"], main["digest"]).alias("payload_digest"),
        main["type"].alias("record_type"),
        "refers_to",
    )


QUERIES = {"op9_warc": op9_warc}
ORACLES = {
    "op9_warc": """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, strlen(html)::bigint as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (i // 8) * 10 + 1, 10))::ubigint >> (35 - 5 * (i % 8))::ubigint) & 31)::integer + 1, 1)), '') as payload_digest
  from p
)
select page_id, payload_bytes, payload_digest,
  case when page_id = min(page_id) over (partition by payload_digest) then 'response' else 'revisit' end as record_type,
  case when page_id > min(page_id) over (partition by payload_digest) then min(page_id) over (partition by payload_digest) end as refers_to
from d
"""
}
