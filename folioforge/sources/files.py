"""Readers and writers of records: bank exports, JSON lines, golden sets, reports and traces."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.functions import numbers


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of a folder, not of its subfolders: path, length, content and document_name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder)
    return files.withColumn("document_name", F.element_at(F.split("path", "/"), -1))


def bank_rows(raw: DataFrame) -> DataFrame:
    """Transactions from text columns: amounts are read and made positive, rows without one dropped.

    ``bank_pos`` keeps the order of the file, which decides between equal matches.
    """
    filled = raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("txn_id", "date", "counterparty", "reference", "category")], F.coalesce("amount", F.lit("")).alias("raw_amount"), *(["bank_pos"] if "bank_pos" in raw.columns else [F.monotonically_increasing_id().alias("bank_pos")]))
    return filled.withColumn("amount", F.abs(numbers.money(F.col("raw_amount")))).where("amount is not null")


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """A bank export as CSV with header; quotes are doubled inside quoted text."""
    names = [f.split()[0] for f in schemas.BANK.split(", ")]
    raw = spark.read.csv(path, header=True, schema=None, inferSchema=False, escape='"', multiLine=True, encoding="UTF-8")
    # columns go by the header's names; missing ones are empty
    return bank_rows(raw.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in names]))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records; a malformed line fails the read, blank lines are skipped."""
    return spark.read.schema(schemas.RECORD).json(path, mode="FAILFAST")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set; every line must name its document and hold an object of expected values.

    Lines are read one by one, and problems name the line of the file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    filled = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", "map<string,string>"))
    golden = filled.withColumns({name: F.try_element_at("r", F.lit(name)) for name in ("document_name", "expected")})
    named, held = F.coalesce(F.col("document_name") != "", F.lit(False)), F.startswith(F.ltrim(F.coalesce("expected", F.lit(""))), F.lit("{"))
    checked = golden.agg(F.count("*"), F.count_if(~named), F.count_if(~held)).first()
    if not checked[0]:
        raise ValueError("the golden set is empty")
    for bad, found, problem in ((~named, checked[1], "name its document"), (~held, checked[2], "hold expected values")):
        if found:
            raise ValueError(f"golden line {_first_line(lines, golden.where(bad))} must {problem}")
    return golden.select("document_name", "expected")


def _first_line(lines: DataFrame, some: DataFrame) -> int:
    """The smallest line number, counted in its file, of ``some`` of the lines of files that were read in blocks."""
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = some.groupBy("file", "block").agg(F.min("id").alias("id")).join(blocks.withColumn("before", before), ["file", "block"])
    return placed.agg(F.min(F.col("before") + F.col("id") - F.col("first") + 1)).first()[0]


def write_records(records: DataFrame, path: str, *, order_by: str | None = None, single_file: bool = False, compression: str = "none") -> None:
    """One JSON object a line, nulls kept. A single file is for results that one task can hold. Readers know compressed files by their names."""
    if order_by:
        records = records.orderBy(order_by)
    if single_file:
        records = records.coalesce(1)
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def append_traces(traces: DataFrame, path: str | None) -> None:
    """Add traces to a folder; nothing without one."""
    if path:
        traces.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_report(summary: DataFrame, metrics: DataFrame, failures: DataFrame, documents: DataFrame, path: str) -> None:
    """A report as four JSON folders, and the first two again as one indented object, ``report``.

    Failures and documents grow with the golden set, so they are left to their folders.
    """
    for name, part in (("field_metrics", metrics), ("failures", failures), ("documents", documents)):
        write_records(part, f"{path}/{name}")
    pretty = {"ignoreNullFields": "false", "pretty": "true"}
    summary.select(F.to_json(F.struct("*"), pretty).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    # one row a metric, of which there are some twenty
    own = metrics.agg(F.array_sort(F.collect_list(F.struct("metric_key", *[c for c in metrics.columns if c != "metric_key"]))).alias("field_metrics"))
    both = summary.select(F.struct("*").alias("summary")).join(own)
    both.select(F.to_json(F.struct("*"), pretty).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/report")


def plain(row) -> dict:
    """A row as plain values, for printing."""
    return json.loads(json.dumps(row.asDict(recursive=True), default=str))
