"""A content-addressed WARC archive: payloads once by digest, exact record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:rillgrid:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _field(header: Column, name: str) -> Column:
    got = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(got != "", got)


def write_archive(
    pages: DataFrame, path: str, *, least: int = 1000, date: str = "2024-02-29T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html"
) -> None:
    """Write ``pages`` below ``path``: ``payloads`` (each once, by SHA-256) and ``headers``.

    A header is all of a record before its payload: the WARC lines and the HTTP head.
    Of records whose payloads are equal and have ``least`` bytes or more, the one with
    the largest id is the response (all that share that id are) and the others are
    revisits that refer to it; records of shorter payloads are all responses. A null
    html is an empty payload; a null id is written as null and is below all others; a
    null url leaves its line out; line ends in a url are percent-encoded. Only digests
    are shuffled to choose responses, summed per task first; payloads are shuffled
    once, by digest, after each task has dropped its own repetitions. An empty table
    makes an empty archive; further columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    light = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    chosen = light.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("chosen"), F.count("*").alias("copies"))
    known = light.join(chosen.where("copies > 1").drop("copies"), "digest", "left")
    revisit = F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2)
    )
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    empty = F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.when(revisit, F.lit(f"WARC-Type: revisit{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        line("WARC-Record-ID", _name(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", safe), empty),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            revisit,
            F.concat(
                F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
                line("WARC-Refers-To", _name(F.col("chosen"))),
            ),
        ).otherwise(empty),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF),
    )
    known.select("digest", F.concat(head, http).alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: ``page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, header, payload, record`` (the record's bytes as a WARC file has them).

    Each stored payload is hashed again and must have the digest it is stored by, and
    the digest its header names; otherwise the query fails. Both digests and the length
    are taken once per stored payload, before the join, so a payload that many
    records share is not copied unless ``payload`` or ``record`` is asked for.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.sha1("payload")).otherwise(F.raise_error(F.lit("a payload does not have its digest")))
    stored = stored.select("digest", "payload", checked.alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    whole = spark.read.parquet(f"{path}/headers").join(stored, "digest", "left")
    number = lambda name: F.regexp_extract(_field(F.col("header"), name), r"page:(-?\d+)>", 1).try_cast("long")
    kind = _field(F.col("header"), "WARC-Type")
    named = _field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return whole.select(
        number("WARC-Record-ID").alias("page_id"),
        _field(F.col("header"), "WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        "payload_bytes",
        F.when(named, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload is missing or another"))).alias("payload_digest"),
        "header",
        "payload",
        F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"),
    )


def export_warc(records: DataFrame, path: str, *, per_file: int = 10_000) -> None:
    """Write the records of ``read_archive`` as gzipped WARC files."""
    (
        records.select(F.decode(F.substring(F.col("record"), F.lit(1), F.length("record") - 4), "UTF-8").alias("value"))
        .write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
    )
