"""WARC records whose headers are very long, and archives that lost records."""

import hashlib
import io

import pytest

from folioforge.llm import warc


def test_long_urls_come_back(spark):
    url = "data:text/plain," + "x" * 300_000
    folder = warc.write_pages(spark.createDataFrame([(1, url, "a page"), (2, "u", "b")], "page_id long, url string, html string"))
    rows = {r.record_id: (r.kind, r.uri) for r in warc.read_folder(spark, folder).collect()}
    assert rows == {"<urn:page:1>": ("record", url), "<urn:page:2>": ("record", "u")}
    plain = warc.page_record(1, url, b"p", hashlib.sha1(b"p").hexdigest(), None, "2000-01-01T00:00:00Z")
    assert [f.kind for f in warc.salvage(io.BytesIO(plain * 2), 2 * len(plain))] == ["record", "record"]


def test_lost_records_fail_the_reading_of_a_folder(spark):
    folder = warc.write_pages(spark.createDataFrame([(k, "u", f"page {k}") for k in range(3)], "page_id long, url string, html string").coalesce(1), f"{warc.run_dir(spark, 'lost')}")
    files = spark.read.parquet(f"{folder}/manifest").selectExpr("path", "n_records + 1 n_records")
    assert warc.read_archives(files.select("path")).count() == 3
    with pytest.raises(Exception, match="readable records"):
        warc.read_archives(files).collect()
