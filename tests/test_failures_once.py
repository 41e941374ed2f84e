"""Failed results are told from others behind all steps; a filter would go below them and compute each again."""

from pyspark.sql import functions as F

from folioforge.operators import evaluation
from folioforge.plans import inputs, registry

SMALL = "/root/testdata/sf0.001"


def test_no_filter_goes_below_the_steps(spark):
    results = evaluation.field_results(inputs.golden(spark, SMALL), inputs.records(spark, SMALL).where("record_type <> 'draft'"))
    filters = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Filter")
    assert filters(evaluation.failures(results)) == filters(results)


def test_failures_are_the_failed_results(spark):
    columns = ["document_name", "field_path", "outcome"]
    fields = registry.QUERIES["eval_fields"](spark, SMALL).where(F.col("outcome").isin(*evaluation.FAILED)).select(columns)
    failed = registry.QUERIES["eval_failures"](spark, SMALL)
    assert failed.columns == columns and sorted(failed.collect()) == sorted(fields.collect())
