"""Invoices, payments and labels made from the driver's tables by whole-number arithmetic.

Nothing here is random: every value follows from keys, so SQL can state the expected results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.fields import FIELD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(price: Column) -> Column:
    return F.round(price * 100).cast("long")


def plain(c: Column) -> Column:
    """Cents as 1234.56."""
    return (c.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def grouped(c: Column, thousands: str, point: str) -> Column:
    """Cents as 1,234.56 with other separators."""
    return F.translate(F.format_number(c.cast("decimal(20,0)") / 100, 2), ",.", thousands + point)


def field(value: Column, *, status: Column | None = None, confidence: Column | None = None) -> Column:
    """A found field; null values are unknown."""
    known = F.when(value.isNull(), F.lit("unknown")).otherwise(F.lit("found"))
    return F.struct(
        value.cast("string").alias("raw_value"), value.cast("string").alias("normalized_value"), F.lit(None).cast("string").alias("evidence"), (known if status is None else status).alias("status"), (F.lit("high") if confidence is None else confidence).alias("confidence")
    ).cast(FIELD)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, c (cents, over zero), day and letter of every order. Names are one letter eight times: equal or nothing alike."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.greatest(cents(F.col("o_totalprice")), F.lit(100)).alias("c"), F.to_date("o_orderdate").alias("day"), F.expr("repeat(char(65 + o_custkey % 26), 8)").alias("party"))


def invoice_id(k: Column) -> Column:
    """A number such as IN-1000-00001."""
    return F.concat(F.lit("IN-"), (F.floor(k / 100000) + 1000).cast("string"), F.lit("-"), F.lpad((k % 100000).cast("string"), 5, "0"))


def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, document_name and extraction of every order, some fields wrong by the key."""
    o = orders(spark, sf_dir)
    k = F.col("k")
    net = F.floor(F.col("c") * 4 / 5)
    none = F.lit(None).cast("string")
    total = F.when(k % 41 == 0, none).otherwise(plain(F.col("c")))
    e = F.struct(
        F.concat(F.lit("doc-"), k.cast("string"), F.lit(".pdf")).alias("document_name"),
        F.lit("synthetic").alias("extraction_method"),
        field(F.when(k % 37 == 0, none).otherwise(invoice_id(k))).alias("invoice_id"),
        field(F.col("party"), confidence=F.when(k % 29 == 0, F.lit("medium")).otherwise(F.lit("high"))).alias("supplier_name"),
        field(F.when(k % 31 == 0, F.lit("GBP")).otherwise(F.lit("dkk"))).alias("currency"),
        field(F.date_format("day", "dd.MM.yyyy")).alias("invoice_date"),
        field(none).alias("due_date"),
        field(none).alias("po_reference"),
        F.struct(
            field(plain(net)).alias("pre_tax_amount"),
            field(F.lit("25")).alias("tax_percentage"),
            field(plain(F.col("c") - net + F.when(k % 43 == 0, 100).otherwise(0))).alias("tax_amount"),
            field(none).alias("discount"),
            field(total).alias("total_amount"),
        ).alias("totals"),
        F.array(F.struct(field(F.lit("widgets")).alias("name"), field(F.lit("2")).alias("quantity"), field(plain(net)).alias("amount"), field(F.lit("EUR")).alias("currency"))).alias("line_items"),
        F.array().cast("array<string>").alias("warnings"),
    )
    return o.select("k", "c", e["document_name"].alias("document_name"), e.alias("extraction"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, document_name, text and warnings: an invoice's text for every order."""
    o = orders(spark, sf_dir)
    k, c = F.col("k"), F.col("c")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Faktura "), F.lower(invoice_id(k))),
        F.concat(F.lit("Dato: "), F.date_format("day", "yyyy-MM-dd"), F.lit(" / "), F.date_format("day", "dd.MM.yyyy")),
        F.concat(F.lit("Netto DKK "), grouped(F.floor(c * 4 / 5), ".", ","), F.lit(" + Moms 25%")),
        F.when(k % 23 != 0, F.concat(F.lit("I alt "), grouped(c, ".", ","), F.lit(" DKK, igen "), grouped(c, ".", ","))),
    )
    return o.select("k", F.concat(F.lit("doc-"), k.cast("string"), F.lit(".pdf")).alias("document_name"), lines.alias("text"), F.array().cast("array<string>").alias("warnings"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment for most orders as text columns, with bank_pos: right, 2 % short, without number, or unreadable."""
    o = orders(spark, sf_dir)
    k, c = F.col("k"), F.col("c")
    paid = F.when(k % 5 == 1, F.floor(c * 98 / 100)).otherwise(c)
    reference = F.when(k % 5 == 2, F.lit("payment")).otherwise(F.concat(F.lit("ref "), F.lower(invoice_id(k)), F.lit(" x")))
    return o.where(k % 11 != 0).select(
        F.concat(F.lit("T"), k.cast("string")).alias("txn_id"),
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.when(k % 19 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("-"), plain(paid))).alias("amount"),
        F.col("party").alias("counterparty"),
        reference.alias("reference"),
        F.lit("supplier").alias("category"),
        k.alias("bank_pos"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all three kinds, with rec_id: validated, failed and unknown."""
    e = extraction(spark, sf_dir)
    k = F.col("k")
    path = lambda p: F.struct(F.lit(p).alias("field_path"))
    valid = F.array(path("invoice_id"), path("currency"), path("totals.total_amount"))
    kind = F.when(k % 47 == 0, F.lit("error")).when(k % 53 == 0, F.lit("draft")).otherwise(F.lit("validated_extraction"))
    return e.select(
        k.alias("rec_id"),
        kind.alias("record_type"),
        "document_name",
        "extraction",
        F.when(k % 17 == 0, F.slice(valid, 1, 2)).otherwise(valid).alias("valid_fields"),
        F.when(k % 59 == 0, F.array(path("currency"))).otherwise(F.array().cast("array<struct<field_path:string>>")).alias("invalid_fields"),
        F.array().cast("array<struct<field_path:string>>").alias("unchecked_fields"),
        F.lit("model failed").alias("reason"),
        F.array(F.lit("step")).alias("attempted_steps"),
    )


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_name and expected (JSON text): labels of every order, some absent or null by the key."""
    o = orders(spark, sf_dir)
    k, c = F.col("k"), F.col("c")
    q = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    net = F.floor(c * 4 / 5)
    entries = F.array_compact(
        F.array(
            F.concat(F.lit('"invoice_id":'), q(F.lower(invoice_id(k)))),
            F.concat(F.lit('"supplier_name":'), q(F.concat(F.initcap("party"), F.lit("!")))),
            F.when(k % 13 != 0, F.lit('"currency":"DKK"')),
            F.concat(F.lit('"invoice_date":'), q(F.date_format("day", "yyyy/MM/dd"))),
            F.when(k % 3 == 0, F.lit('"due_date":null')).otherwise(F.lit('"due_date":"2026-01-31"')),
            F.lit('"po_reference":""'),
            F.concat(F.lit('"totals":{"pre_tax_amount":'), q(plain(net)), F.lit(',"tax_percentage":25,"tax_amount":'), q(plain(c - net)), F.lit(',"discount":null,"total_amount":'), q(grouped(c, ",", ".")), F.lit("}")),
            F.concat(F.lit('"line_items":[{"name":"Widget","quantity":2,"amount":'), q(plain(net)), F.lit(',"currency":null}]')),
        )
    )
    return o.select(F.concat(F.lit("doc-"), k.cast("string"), F.lit(".pdf")).alias("document_name"), F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("expected"))
