"""A batch of the stream is read once, needs only parts of the records, and leaves no working files."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from folioforge.operators import routing
from folioforge.plans import inputs, records
from folioforge.sources import files
from folioforge.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def shown(rows):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in rows.drop("rec_id", "batch").collect())


def test_batches_are_read_once_and_decided_as_whole_records_are(spark, tmp_path):
    rows = records._records(spark, SMALL)
    payments = files.bank_rows(inputs.payments(spark, SMALL))
    for name in ("first", "again"):
        files.write_records(rows, str(tmp_path / "in" / name), compression="gzip")
    assert list((tmp_path / "in" / "again").glob("*.json.gz"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("*/batch-*"))
    query = ingest.route_stream(spark, str(tmp_path / "in" / "*"), payments, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(240)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2 * rows.count()
    assert set(shared.glob("*/batch-*")) == before
    whole = routing.triage(files.read_records(spark, str(tmp_path / "in" / "first")), payments)
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == shown(whole)
    assert whole.where(F.col("outcome") == "auto_accept").count()
