"""Structured Streaming: route extraction records as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.functions.fields import TOTAL_PATHS
from folioforge.operators.routing import triage
from folioforge.session import discard, written

STORE = "spark.sql.streaming.stateStore.providerClass"


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction records of a folder of JSON lines, as new files come."""
    return spark.readStream.schema(schemas.RECORD).option("mode", "FAILFAST").json(folder)


def once(records: DataFrame, *, arrived: str = "arrived", within: str = "1 day", kept: dict[str, Column] | None = None) -> DataFrame:
    """Records whose content was not seen within the watermark.

    ``kept`` are the columns that go on, if not all; the content is that of the whole record. Its hash is
    kept as 32 bytes, so checkpoints of versions that kept it as text cannot be continued.
    """
    content = F.unhex(F.sha2(F.to_json(F.struct(*[c for c in records.columns if c != arrived]), {"ignoreNullFields": "false"}), 256))
    columns = [c.alias(name) for name, c in kept.items()] + [arrived] if kept else records.columns
    return records.select(*columns, content.alias("content_hash")).withWatermark(arrived, within).dropDuplicatesWithinWatermark(["content_hash"])


def needed() -> dict[str, Column]:
    """What ``triage`` reads of a record: no line items, warnings, evidence or values of validations."""
    e, none = F.col("extraction"), F.lit(None)
    slim = lambda f: F.when(f.isNotNull(), f.withField("evidence", none.cast("string")))
    names = ("invoice_id", "supplier_name", "currency")
    totals = F.when(e["totals"].isNotNull(), F.struct(*[slim(e["totals"][p]).alias(p) for p in TOTAL_PATHS]))
    own = F.when(e.isNotNull(), F.struct(*[slim(e[p]).alias(p) for p in names], totals.alias("totals")))
    paths = {c: F.transform(c, lambda v: F.struct(v["field_path"].alias("field_path"))) for c in ("valid_fields", "invalid_fields")}
    return {c: F.col(c) for c in ("record_type", "document_name", "reason", "attempted_steps")} | {"extraction": own} | paths


def route_stream(spark: SparkSession, folder: str, bank: DataFrame, out: str, checkpoint: str):
    """Start a query that writes decisions of new records to ``out`` as Parquet, a folder a batch.

    A repeated batch overwrites its own folder, so each record is decided once. Of a batch, new records are
    found once and written, so all steps see the same ids; the copy goes when the batch is decided. What
    was seen is kept on disk (RocksDB), not in the heap.
    """
    records = once(record_stream(spark, folder).withColumn("arrived", F.current_timestamp()), kept=needed())

    def batch(rows: DataFrame, number: int) -> None:
        new = written(rows.drop("arrived", "content_hash").withColumn("rec_id", F.monotonically_increasing_id()), "batch")
        triage(new, bank).drop("rec_id").write.mode("overwrite").parquet(f"{out}/batch={number}")
        discard(new)

    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, old) if old else spark.conf.unset(STORE)
