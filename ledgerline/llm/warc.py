"""Writing pages as WARC records with repeated payloads resolved to revisits, and reading them back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_path, table

#: Base32 of RFC 4648 (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def base32(hexed: Column) -> Column:
    """Base32 of a SHA-1 in hex: each of its 8 runs of 5 digits, 20 bits, is 4 letters of 5."""
    letters = []
    for run in range(8):
        bits = F.conv(F.substring(hexed, 5 * run + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    )
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))


def resolve(pages: DataFrame, *, id_col="page_id", url_col="url", payload_col="html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_url).

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest id is the
    response and the others revisit it; smaller ones are all responses. Headers are summed by digest
    (one row a digest and task) and written, then every record is joined to its digest's original; Spark can split a
    digest that many records share. Null payload: empty. Null id: smallest. Rows that repeat an id and a payload are all
    what that id is; of their urls the largest is referred to. Empty table: no rows. Extra columns are left out.
    Every payload moves once; ``records`` leaves out those of revisits.
    """
    rows = _rows(pages, id_col, url_col, payload_col)
    originals = saved(rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("original")), "warc-originals")
    revisits = F.col("original").isNotNull() & ~F.col("original.page_id").eqNullSafe(F.col("page_id"))
    return (
        rows.join(originals, "sha1", "left")
        .withColumn("record_type", F.when(revisits, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisits, F.col("original.page_id")))
        .withColumn("refers_url", F.when(revisits, F.col("original.url")))
        .withColumn("payload_digest", base32(F.col("sha1")))
        .drop("original", "sha1")
    )


def records(pages: DataFrame, *, id_col="page_id", url_col="url", payload_col="html", min_bytes: int = 0) -> DataFrame:
    """The records of ``resolve`` as they are archived: revisits have no payload (null).

    Headers are written once and summed by digest; revisits come from joining them to their digest's original, a written table, so that Spark can split a digest that
    many records share. A payload moves only in the sum by digest, where a task sends one of each.
    Very long payloads pass whole; a task holds one of each of its digests while it sums, which spills.
    """
    rows = _rows(pages, id_col, url_col, payload_col)
    shared = F.col("payload_bytes") >= min_bytes
    heads = saved(rows.select("page_id", "url", "payload_bytes", "sha1"), "warc-heads").filter(shared)
    originals = saved(heads.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("original")), "warc-originals")
    met = heads.join(originals, "sha1")
    first = F.col("original.page_id").eqNullSafe(F.col("page_id"))
    sums = rows.filter(shared).groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("original"), F.first("payload").alias("payload"), F.first("payload_bytes").alias("payload_bytes"))

    def record(df: DataFrame, page_id: str, url: str, payload: Column, revisit: bool) -> DataFrame:
        to = [F.col(f"original.{c}") if revisit else F.lit(None).cast(kind) for c, kind in (("page_id", "long"), ("url", "string"))]
        return df.select(
            F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), "payload_bytes", F.lit("revisit" if revisit else "response").alias("record_type"),
            to[0].alias("refers_to"), to[1].alias("refers_url"), base32(F.col("sha1")).alias("payload_digest"),
        )

    out = record(sums, "original.page_id", "original.url", F.col("payload"), False)
    out = out.union(record(met.filter(~first), "page_id", "url", F.lit(None).cast("string"), True))
    same = met.filter(first).groupBy("sha1", "page_id", "url", "payload_bytes").agg((F.count("*") - F.max(F.col("original.url").eqNullSafe(F.col("url")).cast("int"))).alias("n")).filter("n > 0")
    same = saved(same, "warc-same")
    if not same.isEmpty():
        each = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).join(sums.select("sha1", "payload"), "sha1")
        out = out.union(record(each, "page_id", "url", F.col("payload"), False))
    if min_bytes > 0:
        out = out.union(record(rows.filter(~shared), "page_id", "url", F.col("payload"), False))
    return out


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2000) -> None:
    """One compressed WARC file a partition and ``records_per_file`` records, with headers made anew. A record of
    the text writer is a WARC record, and its line separator the two empty lines that end one."""
    response = F.col("record_type") == "response"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(response, F.col("payload")).otherwise(F.lit("")))

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))

    clean = lambda c: F.regexp_replace(F.col(c), r"[\r\n]", " ")  # noqa: E731  a line break would end the header
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", _uri(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", clean("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("WARC-Refers-To", F.when(~response, _uri(F.col("refers_to")))),
        field("WARC-Refers-To-Target-URI", clean("refers_url")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    record = F.concat(header, F.lit(CRLF), block).alias("value")
    resolved.select(record).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(uri: str | None) -> int | None:
    number = (uri or "")[len("<urn:page:") : -1]
    return int(number) if number.lstrip("-").isdigit() else None


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file; lengths decide, not what payloads hold."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = _fields(data[at:end])
        start, size = end + 4, int(fields["content-length"])
        if not data.startswith(b"WARC/", at) or data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"not a WARC record at byte {at}")
        yield fields, data[start : start + size]
        at = start + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a record. Bytes and digest come from the payload of a response, from the headers of a revisit."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64
        import gzip
        import hashlib

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                for fields, block in parse(gzip.decompress(content)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(_fields(head)["content-length"])
                    if fields["warc-type"] == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (found, len(payload)) != (digest, size):
                            raise ValueError(f"a payload in {file} does not match its header")
                    out.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), file))
                frame = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    # A file is a row here; records_per_file bounds it, and one at a time goes to Python.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(rows, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(records(table(spark, sf_dir, "pages")), path, records_per_file=500)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((('0x' || substr(hex || '0', ((i * 5) // 4 + 1)::INT, 3))::BIGINT >> (7 - (i * 5) % 4)) & 31) + 1)::INT, 1)), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM m
"""
