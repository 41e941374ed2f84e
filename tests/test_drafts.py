"""Drafts among the records of the evaluation queries: their documents count as failed, and none is left out."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import evaluation
from folioforge.plans import inputs, registry

SMALL = "/root/testdata/sf0.001"


def test_drafts_count_as_failed_documents(spark):
    records = inputs.records(spark, SMALL)
    drafts = [r.document_name for r in records.where("record_type = 'draft'").collect()]
    assert drafts
    with pytest.raises(Exception, match="unsupported record type: draft"):
        evaluation.field_results(inputs.golden(spark, SMALL), records).collect()
    rows = registry.QUERIES["eval_fields"](spark, SMALL)
    found = rows.where(F.col("document_name").isin(drafts) & (F.col("field_path") == "invoice_id")).collect()
    assert sorted(r.document_name for r in found) == sorted(drafts) and {r.outcome for r in found} == {"miss"}
    assert rows.select("document_name").distinct().count() == records.count()
