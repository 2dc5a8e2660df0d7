"""WARC archives: written by Spark's text sink, read back, and assembled into captures.

Each capture is three records: request, response (or revisit) and metadata. The
other two name the response in ``WARC-Concurrent-To``; reading joins the three
through it and gives one nested row per capture.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import cut_lineage, lookup_join, new_path

# Payloads from this size on are stored once; equal ones become revisits.
SMALLEST_SHARED = 1000
# A file is read back as one row. Pages of each class of size, up to so many bytes, go to files of so many records (three a
# page), so the pages of a file are 64 MB at most; a longer page has a file of its own.
FILE_CLASSES = [(65_536, 3_000), (1_048_576, 192), (16_777_216, 12), (None, 3)]
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE_DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


RECORD_SCHEMA = (
    "type string, record_id string, concurrent_to string, refers_to string, url string, digest string, payload binary, bytes long, fields string"
)
# Records, and bytes of payloads, that a worker hands on at a time.
BATCH_RECORDS, BATCH_BYTES = 1_000, 8_388_608


def urn(*parts: Column) -> Column:
    """A record id that depends on ``parts`` only."""
    digest = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(kind: str, identifier: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record; headers whose value is null are left out. The sink adds the last line feed."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), identifier),
             F.lit(f"WARC-Date: {CAPTURE_DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as ``.warc.gz`` files below ``path``.

    Payloads are the pages in UTF-8, null as empty. Of equal payloads of at least
    ``SMALLEST_SHARED`` bytes the one with the largest id is the response and the
    others are revisits of it, without payload; rows that repeat that id and
    payload are responses too. Line breaks in a URL are percent-encoded; a null
    URL has no target header. Groups of equal payloads are found by SHA-256 on
    narrow rows that are counted inside each task first; their table is broadcast up to a
    measured size, and only beyond it payloads move, in salted groups. Files
    are bounded by bytes: each class of page sizes of ``FILE_CLASSES`` is written for itself, below
    a folder of its own. An empty table gives no file with records.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("sha2", F.when(F.col("bytes") >= SMALLEST_SHARED, F.sha2("payload", 256)))
    # One pass for groups and sizes: small pages have no digest here and count for their class only.
    above = F.lit(len(FILE_CLASSES) - 1)
    for n, (most, _) in reversed(list(enumerate(FILE_CLASSES[:-1]))):
        above = F.when(F.col("bytes") <= most, n).otherwise(above)
    rows = rows.withColumn("class", above)
    groups = cut_lineage(
        rows.groupBy("sha2", "class").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")), "warc-groups"
    )
    classes = sorted(r["class"] for r in groups.select("class").distinct().collect()) or [0]
    shared = groups.where("n > 1 AND sha2 IS NOT NULL").select("sha2", "keeper")
    rows = lookup_join(rows, shared, "sha2", salt_by=F.struct("page_id", "url"))
    is_revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    # Ids of responses that others refer to follow from page and payload; all others also from the row's place.
    place = F.when(F.col("keeper").isNotNull() & ~is_revisit, F.lit("")).otherwise(F.col("place").cast("string"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    rows = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("revisit", is_revisit)
    rows = rows.withColumn("id", urn(F.lit("response"), page, F.col("sha1"), place))
    refers = F.when(F.col("revisit"), urn(F.lit("response"), F.col("keeper").cast("string"), F.col("sha1"), F.lit("")))
    concurrent = [("WARC-Target-URI", target), ("WARC-Concurrent-To", F.col("id"))]
    fields = F.concat_ws(
        "\r\n", F.concat(F.lit("page: "), F.col("page_id").cast("string")),
        F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(F.lit("refers-to-page: "), F.col("keeper").cast("string"))), F.lit(""),
    )
    request = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    answer = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest)]
    records = F.array(
        record("request", urn(F.lit("request"), page, F.col("sha1"), F.col("place").cast("string")),
               [*concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        F.when(
            F.col("revisit"),
            record("revisit", F.col("id"), [*answer, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", refers),
                                            ("Content-Type", F.lit("application/http; msgtype=response"))], F.lit(HTTP_HEAD)),
        ).otherwise(
            record("response", F.col("id"), [*answer, ("Content-Type", F.lit("application/http; msgtype=response"))],
                   F.concat(F.lit(HTTP_HEAD), F.col("payload"))),
        ),
        record("metadata", urn(F.lit("metadata"), page, F.col("sha1"), F.col("place").cast("string")),
               [*concurrent, ("Content-Type", F.lit("application/warc-fields"))], fields),
    )
    for n in classes:
        (
            rows.where(F.col("class") == n).select(F.explode(records).alias("value"))
            .write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_CLASSES[n][1])
            .text(f"{path}/size-{n}")
        )


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one unpacked file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = content[at:end].decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        headers = {}
        for line in head[1:]:
            name, _, value = line.partition(": ")
            headers[name.lower()] = value
        start, size = end + 4, int(headers["content-length"])
        yield headers, content[start : start + size]
        at = start + size + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: type, ids, digest in the header, and payload with its own digest and size.

    A payload that does not match its header's digest raises an error; a folder
    without records gives no rows. A worker unpacks one file at a time, whose size its writer
    bounds, and hands its records on in small batches.
    """

    def unpacked(content: bytes) -> bytes:
        members = []
        while content:
            member = zlib.decompressobj(wbits=31)
            members.append(member.decompress(content))
            content = member.unused_data
        return b"".join(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for row in records_of(unpacked(batch.column(0)[k].as_py())):
                    rows.append(row)
                    size += len(row[6] or b"")
                    if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        kinds = [pa.binary() if n == "payload" else pa.int64() if n == "bytes" else pa.string() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    def records_of(content: bytes) -> Iterator[tuple]:
        for headers, block in parse_archive(content):
            kind = headers["warc-type"]
            payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
            digest = hashlib.sha1(payload).hexdigest() if payload is not None else None
            told = headers.get("warc-payload-digest", "sha1:").removeprefix("sha1:")
            if digest is not None and digest != told:
                raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
            yield (
                kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                headers.get("warc-target-uri"), told or None, payload, None if payload is None else len(payload),
                block.decode("utf-8") if kind in ("metadata", "request") else None,
            )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(run, RECORD_SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, url, type, digest, payload, bytes, refers_to, request, metadata``.

    Request and metadata records find their response through the record they
    are concurrent to. Repeated rows share a record id; they are told apart by
    their order among records of that id. Records without a ``payload`` column
    give captures without one; an empty table gives none.
    """
    from pyspark.sql.window import Window

    def numbered(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("own")))

    answers = numbered(records.where(F.col("type").isin("response", "revisit")).withColumn("own", F.col("digest")), "record_id")
    requests = numbered(records.where(F.col("type") == "request").withColumn("own", F.col("record_id")), "concurrent_to").select(
        F.col("concurrent_to").alias("record_id"), "nth", F.struct(F.col("record_id").alias("id"), "fields").alias("request")
    )
    metadata = numbered(records.where(F.col("type") == "metadata").withColumn("own", F.col("record_id")), "concurrent_to").select(
        F.col("concurrent_to").alias("record_id"), "nth", F.struct(F.col("record_id").alias("id"), "fields").alias("metadata")
    )
    joined = answers.join(requests, ["record_id", "nth"], "left").join(metadata, ["record_id", "nth"], "left")
    payload = ["payload"] if "payload" in records.columns else []
    return joined.select("record_id", "url", "type", "digest", *payload, "bytes", "refers_to", "request", "metadata")


def field(name: str) -> Column:
    """A line of the capture's metadata record."""
    value = F.regexp_extract(F.col("metadata.fields"), rf"(?m)^{re.escape(name)}: (-?[0-9]+)\r?$", 1)
    return F.when(value != "", value.cast("long"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and list the captures by page.

    Archives are read and checked once; what the captures need of the records is written without payloads.
    Repeated rows are captures of their own; an empty table gives an empty result.
    """
    path = new_path(spark, "warc")
    write_archives(pages, path)
    records = cut_lineage(read_records(spark, path).drop("payload"), "warc-records")
    return captures(records).select(
        field("page").alias("page_id"), field("payload-bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), field("refers-to-page").alias("refers_to"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
b AS (SELECT page_id, x, octet_length(encode(x)) AS n FROM p),
k AS (SELECT x, max(page_id) AS keeper FROM b WHERE n >= 1000 GROUP BY x)
SELECT page_id, n AS payload_bytes, sha1(b.x) AS payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM b LEFT JOIN k ON b.x = k.x AND n >= 1000"""
