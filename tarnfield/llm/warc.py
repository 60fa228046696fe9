"""WARC archives by Spark's own writers, and transactions assembled from their records.

write puts a request, a response (or revisit) and a metadata record for each row of pages; request and metadata name the
response in WARC-Concurrent-To. Archives are gzip files written through Spark's committed text writer (a record is a row,
records are parted by an empty line), so any file system will do. Pages go to archives of their size class (CLASSES), each
with a number of captures for a file, so that no archive but one of a single page has over about 64 MB. read parses them, a
file a row, one record at a time by Content-Length; offsets are those of the uncompressed archive. assemble joins the
records of a transaction through their concurrent-to identifiers and gives one nested row for each capture.

Of captures with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id (null last) is the response,
the others are revisits without a payload. Every row is a capture of its own: rows that repeat a page_id, with the same
payload or another, and rows with a null page_id are kept; of rows with the smallest page_id and the same payload one is the
response, the others are revisits of their own page_id. A null html is an empty payload. An empty table gives an empty
result. Other columns than page_id, url and html aren't read; line breaks in a url are escaped.

Payloads that several rows share are found by their digests alone. Html is shuffled only if there are more such payloads than
may be broadcast.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, small, stored

MIN_REVISIT = 100
#: Bytes of html from which on a page is of the class, and captures of it in an archive.
CLASSES = ((0, 2000), (32 << 10, 64), (1 << 20, 1))
_DATE = "2020-01-01T00:00:00Z"
_NS = "urn:tarnfield"


def shared_payloads(pages: DataFrame) -> DataFrame:
    """digest, first (smallest page_id), ties (rows with that page_id) of the payloads that several rows have."""
    rows = pages.filter(F.octet_length("html") >= MIN_REVISIT).groupBy(_digest().alias("digest"), "page_id").agg(F.count("*").alias("n"))
    low = rows.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("low"), F.sum("n").alias("n"))
    return low.filter("n > 1").select("digest", F.col("low.page_id").alias("first"), F.col("low.n").alias("ties"))


def _digest() -> Column:
    return F.sha2(F.col("html").cast("binary"), 256)


def _roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, shared (several rows have the payload), first, response (the row holds the payload)."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    shared = stored(shared_payloads(src), "shared-payloads")
    tied = shared.filter("ties > 1")
    if tied.limit(1).count():
        # rows that are alike but for their place need a place that is the same in each scan
        src = stored(src, "pages").withColumn("at", F.struct("_metadata.file_path", "_metadata.row_index"))
        own = src.filter(F.octet_length("html") >= MIN_REVISIT).select(_digest().alias("digest"), "page_id", "at")
        lowest = own.join(small(tied.select("digest", "first")), "digest").filter(F.col("page_id").eqNullSafe(F.col("first"))).groupBy("digest").agg(F.min("at").alias("low_at"))
        shared = stored(shared.join(lowest, "digest", "left"), "shared-payloads")
    else:
        src, shared = src.withColumn("at", F.lit(0)), shared.withColumn("low_at", F.lit(None).cast("int"))
    small_ones = small(shared.select(F.col("digest").alias("s_digest"), "first", "low_at", F.lit(True).alias("shared")))
    src = src.withColumn("digest", _digest())
    src = src.join(small_ones, (F.octet_length("html") >= MIN_REVISIT) & (F.col("digest") == F.col("s_digest")), "left")
    leads = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("low_at").isNull() | (F.col("at") == F.col("low_at")))
    return src.select("page_id", "url", "html", "digest", "first", (F.col("shared").isNull() | leads).alias("response"))


def _record(kind: str, uri: Column, fields: list[tuple[str, Column]], body: Column) -> Column:
    """A record as text; the writer's line separator is what stands behind each."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), uri, F.lit(f">\r\nWARC-Date: {_DATE}\r\n")]
    for name, value in fields:
        lines += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def records(rows: DataFrame, tag: str) -> DataFrame:
    """A row `value` for each record: three for each row of _roles(). A response whose payload may be shared is named after
    page_id and digest, others after page_id and a number of the written row."""
    name = lambda of, own: F.concat(F.coalesce(F.col(of).cast("string"), F.lit("-")), F.lit(":"), own)
    whole = F.col("response") & (F.octet_length("html") >= MIN_REVISIT)
    own = F.when(whole, F.col("digest")).otherwise(F.concat(F.lit(f"row{tag}-"), F.monotonically_increasing_id().cast("string")))
    src = rows.select("*", name("page_id", own).alias("name"), name("first", F.col("digest")).alias("refers"))
    uri = lambda kind, of="name": F.concat(F.lit(f"{_NS}:{kind}:"), F.col(of))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    size = F.octet_length("html").cast("string")
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))]
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    http = [("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", uri("response"), common + http, F.concat(head, F.col("html")))
    revisit = _record("revisit", uri("response"), [*common, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", angle(uri("response", "refers"))), *http], head)
    to = ("WARC-Concurrent-To", angle(uri("response")))
    request = _record("request", uri("request"), [("WARC-Target-URI", F.col("url")), to, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", uri("metadata"), [("WARC-Target-URI", F.col("url")), to, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payload-length: "), size, F.lit("\r\n")))
    return src.select(F.explode(F.array(request, F.when(F.col("response"), response).otherwise(revisit), metadata)).alias("value"))


def write(pages: DataFrame, folder: str) -> str:
    """One write for each size class that has pages (the first always)."""
    rows, size = _roles(pages), F.octet_length(F.coalesce("html", F.lit("")))
    held = pages.agg(*[F.max(size >= low) for low, _ in CLASSES]).first()
    for k, (low, captures) in enumerate(CLASSES):
        if k and not held[k]:
            continue
        own = rows.filter(F.octet_length("html") >= low) if k else rows
        if k + 1 < len(CLASSES) and held[k + 1]:
            own = own.filter(F.octet_length("html") < CLASSES[k + 1][0])
        (records(own, str(k)).write.mode("append").option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 3 * captures).text(folder))
    return folder


_FIELDS = "file string, offset long, type string, id string, concurrent_to string, refers_to string, uri string, digest_field string, block_bytes long, payload_bytes long, payload_digest string, block binary"


def parse(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields and block of each record of an uncompressed archive."""
    while True:
        at = stream.tell()
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            at = stream.tell()
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError(f"record at {at} is cut short")
        yield at, fields, block


def _parsed(keep_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.int64(), pa.string(), pa.binary()]
        bare = lambda x: x[1:-1] if x and x[0] == "<" else x
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                raw = content.as_buffer()
                stream = gzip.GzipFile(fileobj=pa.BufferReader(raw)) if bytes(raw[:2]) == b"\x1f\x8b" else io.BytesIO(raw.to_pybytes())
                for at, f, block in parse(io.BufferedReader(stream)):
                    kind = f.get("warc-type")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = hashlib.sha256(payload).hexdigest() if payload is not None else None
                    if digest and f.get("warc-payload-digest", "").lower() not in ("", f"sha256:{digest}"):
                        raise ValueError(f"payload of the record at {at} in {path} doesn't match its digest")
                    rows.append((path, at, kind, bare(f.get("warc-record-id")), bare(f.get("warc-concurrent-to")), bare(f.get("warc-refers-to")), f.get("warc-target-uri"), f.get("warc-payload-digest"), len(block), None if payload is None else len(payload), digest, block if keep_block or kind == "metadata" else None))
                    size += len(block)
                    if len(rows) >= 2000 or size > 1 << 24:
                        yield make(rows)
                        rows, size = [], 0
                if rows:
                    yield make(rows)

    return run


def read(spark: SparkSession, folder: str, keep_block: bool = True) -> DataFrame:
    """A row for each record of the folder's archives; keep_block False leaves out all blocks but metadata's."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_parsed(keep_block), _FIELDS)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row for each capture: id, request, response (or revisit), metadata.

    Records meet under the identifier that they name in WARC-Concurrent-To, or their own if they name none; of several
    records of a kind the one at the lowest (file, offset) stays. A record that nothing joins is a row by itself.
    """
    body = F.struct("file", "offset", "type", "id", "refers_to", "uri", "digest_field", "block_bytes", "payload_bytes", "payload_digest", "block")
    keyed = rows.select(F.coalesce("concurrent_to", "id").alias("capture"), "type", body.alias("r")).filter("capture is not null")
    one = lambda *kinds: F.min(F.when(F.col("type").isin(*kinds), F.col("r")))
    return keyed.groupBy("capture").agg(one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))


def captures(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, from archives written and read back."""
    spark = pages.sparkSession
    folder = write(pages, scratch(spark, "warc"))
    nested = stored(assemble(read(spark, folder, keep_block=False)), "captures")
    number = lambda c: F.substring_index(F.substring_index(c, ":", -2), ":", 1).try_cast("long")
    own = nested.filter("response is not null").select("capture", "response.*")
    again = own.filter("type = 'revisit'").select("capture", "refers_to", "uri")
    # a payload that many captures refer to is looked up once
    named = again.select(F.col("refers_to").alias("f_id")).distinct()
    full = own.filter("type = 'response'").select(F.col("capture").alias("f_id"), F.col("payload_bytes").alias("f_bytes"), F.col("payload_digest").alias("f_digest"))
    full = small(stored(full.join(small(stored(named, "referred")), "f_id", "left_semi"), "payloads"))
    again = again.join(full, F.col("refers_to") == F.col("f_id")).select("capture", F.col("f_bytes").alias("payload_bytes"), F.col("f_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), number(F.col("refers_to")).alias("refers_to"), "uri")
    first = own.filter("type = 'response'").select("capture", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "uri")
    return first.union(again).select(number(F.col("capture")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("uri").alias("url"))
