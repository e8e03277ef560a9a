"""WARC archives without repeated payloads.

Headers (not payloads) are shuffled by payload digest; in each group the record
with the largest id is the response and the others become revisit records that
point at it.  Payloads move once, and only those of responses are written.  The
archives are written by Spark's text writer: a record is text in UTF-8, and the
line separator is the CR LF CR LF that ends WARC records.  Each archive begins
with its own warcinfo record.  Archives hold about ``ARCHIVE_BYTES`` of payload
(one record at least) and are read record by record, so that a task holds one
compressed archive and some records.  (An archive is one gzip member as a whole;
``compression="none"`` writes it plain.)

Defined results: a null html is an empty payload.  Rows that share the largest
id of their group: the one with the smallest url is the response; of fully equal
rows, one.  A null id loses to any other and can be a revisit.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

END = "\r\n\r\n"
#: Payload bytes of an archive, on average, and of a batch that is read.
ARCHIVE_BYTES, BATCH_BYTES = 64_000_000, 4_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: Column) -> Column:
    """Bare base32 SHA-1 of a text's UTF-8 bytes: four times 40 bits as eight digits."""
    sha = F.sha1(payload.cast("binary"))
    part = lambda k: F.lpad(F.upper(F.conv(F.substring(sha, 10 * k + 1, 10), 16, 32)), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, url: Column, sha: Column, copy: Column) -> Column:
    h = F.sha1(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("")), sha, copy.cast("string")).cast("binary"))
    return _urn(h)


def _urn(h: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _headers(*lines: tuple[str, Column]) -> Column:
    return F.concat(*(F.when(v.isNull(), "").otherwise(F.concat(F.lit(f"{k}: "), F.regexp_replace(v.cast("string"), "[\r\n]", " "), F.lit("\r\n"))) for k, v in lines))


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """Decide each record's type from its header.

    ``headers``: page_id, url, digest, payload_bytes.  Equal headers come as one
    row with their number ``copies``; ``first`` tells that one of them is the
    response; ``to_id`` and ``to_url`` name it.
    """
    groups = headers.groupBy("page_id", "url", "digest", "payload_bytes").agg(F.count("*").alias("copies"))
    large = groups.filter(F.col("payload_bytes") >= least)
    # by largest id, then smallest url; partial sums before the shuffle keep a hot digest small
    best = large.groupBy("digest").agg(F.max("page_id").alias("to_id"))
    url = large.join(best, "digest").filter(F.col("page_id").eqNullSafe(F.col("to_id"))).groupBy("digest", "to_id").agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url")).alias("u"))
    out = groups.join(url.select("digest", "to_id", F.col("u.url").alias("to_url")), "digest", "left")
    small = F.col("payload_bytes") < least
    first = small | (F.col("page_id").eqNullSafe(F.col("to_id")) & F.col("url").eqNullSafe(F.col("to_url")))
    return out.withColumn("first", first).withColumn("small", small)


def _when(date: str | None) -> Column:
    return F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str | None = None) -> DataFrame:
    """The WARC records of ``pages`` as text, without the ending CR LF CR LF."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", "html", digest(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    found = resolve(rows.drop("html"), least)
    when = _when(date)

    def head(kind: str, copy: Column, *more: tuple[str, Column]) -> Column:
        fixed = (("WARC-Type", F.lit(kind)), ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"), copy)), ("WARC-Date", when), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")))
        own = (("Content-Type", F.lit("application/http; msgtype=response")), ("X-Page-Id", F.col("page_id")), ("X-Payload-Bytes", F.col("payload_bytes")))
        return F.concat(F.lit("WARC/1.1\r\n"), _headers(*fixed, *more, *own))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    whole = lambda headers, block: F.concat(headers, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)

    # responses: one row of html for each group of equal headers that holds one; small payloads keep every copy.
    # Grouping and join share one key, so payloads are shuffled once.
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.when(F.col("url").isNull(), "-").otherwise("+"), F.col("digest"), "url").cast("binary"))
    chosen = found.filter("first").select(key.alias("k"), "copies", "small")
    one = rows.withColumn("k", key).groupBy("k").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "digest", "payload_bytes", "html")))
    kept = one.join(chosen, "k")
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("small"), F.col("copies")).otherwise(1))))
    responses = kept.select(whole(head("response", F.col("copy")), F.concat(http, "html")).alias("value"))

    again = found.filter("not small").withColumn("copy", F.explode(F.sequence(F.when(F.col("first"), F.lit(2)).otherwise(F.lit(1)).cast("long"), F.col("copies") + 1))).filter(F.col("copy") <= F.col("copies"))
    to = (("WARC-Refers-To", _record_id(F.col("to_id"), F.col("to_url"), F.col("digest"), F.lit(1))), ("WARC-Refers-To-Target-URI", F.col("to_url")), ("WARC-Profile", F.lit(PROFILE)), ("X-Refers-To-Page", F.col("to_id")))
    revisits = again.select(whole(head("revisit", F.col("copy"), *to), http).alias("value"))
    return responses.unionByName(revisits)


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip", html_col: str = "html", date: str | None = None, **options) -> None:
    """Write the records of ``pages`` to archives of about ``archive_bytes`` of payload under ``path``."""
    n, size = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(html_col).cast("long")), F.lit(0))).first()
    per_file = max(1, n * archive_bytes // max(size, n, 1))
    info = f"software: codeloom{chr(13)}{chr(10)}format: WARC File Format 1.1{chr(13)}{chr(10)}"
    head = F.concat(F.lit("WARC/1.1\r\n"), _headers(("WARC-Type", F.lit("warcinfo")), ("WARC-Record-ID", _urn(F.sha1("value"))), ("WARC-Date", _when(date)), ("Content-Type", F.lit("application/warc-fields")), ("Content-Length", F.lit(len(info)))), F.lit("\r\n" + info + END))
    # the first record of each file: the writer begins a new one every per_file records of a partition
    first = F.expr("monotonically_increasing_id() & 8589934591") % per_file == 0
    rows = records(pages, html_col=html_col, date=date, **options)
    rows = rows.select(F.when(first, F.concat(head, "value")).otherwise(F.col("value")).alias("value"))
    rows.write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path, compression=compression)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive, plain or in gzip, one at a time."""
    f = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        f = io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 16)
    while first := f.readline():
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"no record: {first[:40]!r}")
        headers = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k.lower()] = v
        block = f.read(int(headers["content-length"]))
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("no end of record")
        yield headers, block


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload).

    A response whose payload does not have its digest raises an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] * payloads)]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.string()] * payloads)]

    def run(batches):
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(columns))], columns)
        for b in batches:
            for x in b.column(0):
                rows, size = [], 0
                for h, block in parse(x.as_py()):
                    if h["warc-type"] == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    sha = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha:
                        raise ValueError(f"{h['warc-record-id']}: the payload does not have its digest")
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append((number("x-page-id"), h.get("warc-target-uri"), h["warc-type"], number("x-payload-bytes"), sha, number("x-refers-to-page"), *([payload.decode()] * payloads)))
                    size += 500 + len(payload) * payloads
                    if size > BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload string" * payloads)


def deduplicated(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
