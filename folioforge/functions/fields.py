"""Access to extracted fields: structs of raw_value, normalized_value, evidence, status, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import numbers

DOCUMENT_PATHS = ("invoice_id", "supplier_name", "currency", "invoice_date", "due_date", "po_reference")
TOTAL_PATHS = ("pre_tax_amount", "tax_percentage", "tax_amount", "discount", "total_amount")
ITEM_PATHS = ("name", "quantity", "amount", "currency")


def at(extraction: Column, path: str) -> Column:
    """The field at a dotted path."""
    for part in path.split("."):
        extraction = extraction.getField(part)
    return extraction


def stated(field: Column) -> Column:
    """normalized_value, or raw_value if that is null or empty, whatever the status."""
    return F.coalesce(F.nullif(field.getField("normalized_value"), F.lit("")), field.getField("raw_value"))


def value(field: Column) -> Column:
    """As ``stated``, but null if the status is unknown."""
    return F.when(~field.getField("status").eqNullSafe(F.lit("unknown")), stated(field))


def money(field: Column) -> Column:
    return numbers.money(value(field))


def confidence(field: Column) -> Column:
    return F.coalesce(field.getField("confidence"), F.lit("unknown"))


def all_fields(extraction: Column) -> Column:
    """Every field of an extraction, those of its line items last."""
    own = [at(extraction, p) for p in DOCUMENT_PATHS] + [at(extraction, f"totals.{p}") for p in TOTAL_PATHS]
    items = F.flatten(F.transform(extraction.getField("line_items"), lambda item: F.array(*[item.getField(p) for p in ITEM_PATHS])))
    return F.concat(F.array(*own), F.coalesce(items, F.array().cast("array<" + FIELD + ">")))


FIELD = "struct<raw_value:string,normalized_value:string,evidence:string,status:string,confidence:string>"
