import gzip
import hashlib
from pathlib import Path

import pytest

from rillgrid.llm import warc

LONG, OTHER = "<p>é</p>" * 300, "<b>x</b>" * 200


@pytest.fixture()
def pages(spark):
    rows = [(k, f"http://a/{k}", LONG, "z") for k in (5, 9, 2, 7)] + [(k, "http://b\r\nX: y", "<i>short</i>", "z") for k in (1, 3)]
    rows += [(4, None, OTHER, "z"), (6, "u", None, "z"), (8, "u", "", None), (None, "u", LONG, "z"), (None, "u", "WARC/1.1\r\n\r\n" * 100, "z")]
    rows += [(9, "http://a/9", LONG, "z")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


def test_archive_gives_back_every_record(spark, pages, tmp_path):
    rows, df = pages
    warc.write_archive(df, str(tmp_path / "a"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, str(tmp_path / "a")).collect()), key=str)
    want = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        top = max((p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(raw) >= 1000 and top is not None and page != top
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({r[2] or "" for r in rows})


def test_records_parse_as_warc(spark, pages, tmp_path):
    rows, df = pages
    warc.write_archive(df, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    warc.export_warc(records, str(tmp_path / "w"))
    found = []
    for f in Path(tmp_path / "w").glob("part-*.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            block, data = rest[:n], rest[n + 4 :]
            assert rest[n : n + 4] == b"\r\n\r\n"
            body = block.partition(b"\r\n\r\n")[2]
            if fields[b"WARC-Type"] == b"response":
                assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(body).hexdigest().encode()
            found.append(fields[b"WARC-Type"])
    assert len(found) == len(rows)


def test_a_damaged_payload_is_found(spark, pages, tmp_path):
    warc.write_archive(pages[1], str(tmp_path / "a"))
    from pyspark.sql import functions as F

    spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, str(tmp_path / "b")).select("payload_digest").collect()


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0
