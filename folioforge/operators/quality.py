"""Quality of a document's text: where it came from and whether it looks scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import stripped

SCANNED, SPARSE = 40, 120


def classify(texts: DataFrame, *, scanned_below: int = SCANNED, sparse_below: int = SPARSE) -> DataFrame:
    """document_name, text, text_source, character_count, flags and warnings.

    ``texts`` has document_name, pages and embedded_text, and, where OCR was tried, ocr_text and
    ocr_warnings (null elsewhere). Whether a page looks scanned depends on its embedded text, also
    after OCR; the count is that of the text that is kept.
    """
    staged = texts.withColumns({"_own": F.when(F.col("pages") > 0, stripped(F.coalesce("embedded_text", F.lit("")))).otherwise(F.lit("")), "_ocr": stripped(F.coalesce("ocr_text", F.lit(""))), "_tried": F.col("ocr_warnings").isNotNull()})
    n_own = F.length("_own")
    scanned = n_own < scanned_below
    used = F.col("_tried") & (F.col("_ocr") != "")
    text = F.when(used, F.col("_ocr")).otherwise(F.col("_own"))
    state = (
        F.when(F.col("pages") == 0, F.lit("pdf_has_no_content"))
        .when(n_own == 0, F.lit("no_embedded_text_found"))
        .when(scanned, F.lit("embedded_text_is_too_sparse"))
        .when(n_own < sparse_below, F.lit("embedded_text_may_be_incomplete"))
    )
    extension = F.when(~F.lower("document_name").endswith(".pdf"), F.lit("file_extension_is_not_pdf"))
    own = F.array_compact(F.array(extension, state, F.when(F.col("_tried"), F.lit("ocr_attempted"))))
    warnings = F.concat(own, F.coalesce("ocr_warnings", F.array().cast("array<string>")), F.array_compact(F.array(F.when(used, F.lit("ocr_text_used")))))
    source = F.when(used, F.lit("ocr")).when(n_own > 0, F.lit("embedded_text")).otherwise(F.lit("none"))
    return staged.select("document_name", text.alias("text"), source.alias("text_source"), F.length(text).alias("character_count"), (~scanned).alias("is_text_native"), scanned.alias("looks_scanned"), warnings.alias("warnings"))
