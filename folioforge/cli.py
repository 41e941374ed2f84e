"""Commands: inspect-text, inspect-candidates, extract, triage and evaluate."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioforge.operators import evaluation, summaries
from folioforge.operators.routing import triage
from folioforge.session import written
from folioforge.sources import files, providers

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioforge", description=__doc__)
    top.add_argument("--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command")

    def add(name: str, handler, *, documents: bool = True, model: bool = False) -> argparse.ArgumentParser:
        command = commands.add_parser(name)
        command.set_defaults(handler=handler)
        command.add_argument("--out", required=True)
        command.add_argument("--single-file", action="store_true", help="one task writes one file; for small results")
        if documents:
            command.add_argument("--texts", help="recorded texts, JSON lines of document_name and text; else PDF text is read")
            command.add_argument("--ocr", action=argparse.BooleanOptionalAction, default=True)
            command.add_argument("--tesseract-cmd", default="tesseract")
            command.add_argument("--ocr-lang", default=providers.LANGUAGES)
        if model:
            command.add_argument("--model-replay", help="recorded extractions, JSON lines; else the service at --model-url is asked")
            command.add_argument("--model-url", default=os.environ.get("FOLIOFORGE_MODEL_URL"))
            command.add_argument("--model", default=os.environ.get("FOLIOFORGE_MODEL", "recorded"))
            command.add_argument("--reasoning-effort", default=os.environ.get("FOLIOFORGE_REASONING_EFFORT", "minimal"))
            command.add_argument("--trace-out", default=os.environ.get("FOLIOFORGE_TRACE_OUT"))
            command.add_argument("--no-trace", action="store_true")
        return command

    for name, handler in (("inspect-text", inspect_text), ("inspect-candidates", inspect_candidates)):
        add(name, handler).add_argument("pdf_dir", nargs="?", default="pdf_invoices")
    add("extract", extract, model=True).add_argument("pdf_dir", nargs="?", default="pdf_invoices")
    command = add("triage", route, documents=False)
    command.add_argument("--extractions", required=True)
    command.add_argument("--bank", required=True)
    command = add("evaluate", evaluate, model=True)
    command.add_argument("--golden", required=True)
    command.add_argument("--extractions", help="records that extract wrote; else the files of --pdf-dir are extracted")
    command.add_argument("--pdf-dir")
    command.add_argument("--fail-under", type=float)
    command.add_argument("--fail-on-errors", action="store_true")
    return top


def _documents(spark: SparkSession, args):
    """The PDF files, with recorded texts if there are any."""
    documents = files.read_documents(spark, args.pdf_dir)
    if not args.texts:
        return documents
    texts = spark.read.schema("document_name string, text string").json(args.texts).dropDuplicates(["document_name"])
    return documents.join(texts.withColumnRenamed("text", "recorded"), "document_name", "left")


def _ocr(args):
    command, languages = args.tesseract_cmd, args.ocr_lang
    return (lambda: providers.TesseractOcr(command, languages)) if args.ocr else None


def _written(spark: SparkSession, records, args):
    files.write_records(records, args.out, order_by="document_name", single_file=args.single_file)
    return spark.read.schema(records.schema).json(args.out)


def inspect_text(spark: SparkSession, args) -> int:
    done = _written(spark, providers.text_records(_documents(spark, args), providers.PdfText, _ocr(args)), args)
    n = summaries.text_counts(done).first()
    _details(done, ["reason", "warnings"], "record_type = 'error' or size(warnings) > 0")
    print(f"Wrote {args.out}")
    print(f"Processed {n.records} files: {n.text_reports} text reports, {n.scanned} scanned-like, {n.ocr} OCR, {n.errors} errors.")
    return 0


def inspect_candidates(spark: SparkSession, args) -> int:
    done = _written(spark, providers.candidate_records(_documents(spark, args), providers.PdfText, _ocr(args)), args)
    n = summaries.candidate_counts(done).first()
    _details(done, ["reason", "warnings"], "record_type = 'error' or size(warnings) > 0")
    print(f"Wrote {args.out}")
    print(f"Processed {n.records} files: {n.candidate_reports} candidate reports, {n.empty} empty, {n.errors} errors.")
    return 0


def _details(records, shown: list[str], condition: str, limit: int = 20) -> None:
    """Lines about single documents, in order; many are cut short on the screen, never in the files."""
    rows = records.where(condition).select("document_name", *shown).orderBy("document_name").limit(limit + 1).collect()
    for row in rows[:limit]:
        print(f"- {row[0]}: " + " | ".join(", ".join(v) if isinstance(v, list) else str(v) for v in row[1:] if v is not None))
    if len(rows) > limit:
        print("- ...")


def _extracted(spark: SparkSession, args) -> providers.PipelineRun:
    """The pipeline's run over the folder of PDF files."""
    recorded = None
    if args.model_replay:
        # a line is an extraction, or an object that holds one
        name = F.coalesce(F.get_json_object("value", "$.document_name"), F.get_json_object("value", "$.extraction.document_name"))
        lines = spark.read.text(args.model_replay).where(F.trim("value") != "")
        recorded = lines.select(name.alias("document_name"), F.coalesce(F.get_json_object("value", "$.extraction"), F.col("value")).alias("recorded"))
    elif not args.model_url:
        raise SystemExit("give --model-replay or --model-url")
    replay, url, model, effort = bool(args.model_replay), args.model_url, args.model, args.reasoning_effort
    provider = lambda: providers.ReplayedModel({}, None, model, effort) if replay else providers.HttpModel(url, model, effort)
    config = providers.PipelineConfig(provider, providers.PdfText, _ocr(args), None if args.no_trace else args.trace_out)
    return providers.run_pipeline(_documents(spark, args), config, recorded)


def extract(spark: SparkSession, args) -> int:
    done = _written(spark, _extracted(spark, args).records, args)
    n = summaries.extraction_counts(done).first()
    _details(done, ["reason"], "record_type = 'error'")
    print(f"Wrote {args.out}")
    print(f"Processed {n.records} files: {n.validated} validated extractions, {n.invalid_fields} invalid fields, {n.errors} errors.")
    return 0


def route(spark: SparkSession, args) -> int:
    records = files.read_records(spark, args.extractions).withColumn("rec_id", F.monotonically_increasing_id())
    decisions = triage(records, files.read_bank(spark, args.bank))
    files.write_records(decisions.orderBy("rec_id").drop("rec_id"), args.out, single_file=args.single_file)
    done = spark.read.schema(decisions.drop("rec_id").schema).json(args.out)
    n = summaries.outcome_counts(done).first()
    _details(done, ["outcome", "match_status", "reasons"], "outcome <> 'auto_accept'")
    print(f"Wrote {args.out}")
    print(f"Triaged {n.records} invoices: {n.auto_accept} auto-accept, {n.review} review, {n.reject} reject.")
    return 0


def evaluate(spark: SparkSession, args) -> int:
    golden = files.read_golden(spark, args.golden)
    if args.extractions:
        records = files.read_records(spark, args.extractions)
    elif args.pdf_dir:
        records = written(_extracted(spark, args).records, "records")
    else:
        raise SystemExit("give --extractions or --pdf-dir")
    results, documents = written(evaluation.field_results(golden, records), "results"), evaluation.document_results(golden, records)
    total = evaluation.summary(results, documents)
    files.write_report(total, evaluation.by_metric(results).orderBy("metric_key"), evaluation.failures(results), evaluation.nested(results, documents), args.out)
    n = total.first()
    _details(evaluation.failures(results), ["field_path", "outcome", "reason"], "true")
    print(f"Wrote {args.out}")
    print(f"Evaluated {n.documents} documents: {n.correct}/{n.total} correct fields, {n.accuracy:.1%} accuracy, {n.hallucinations} hallucinations, {n.misses} misses, {n.extraction_errors} extraction errors.")
    return evaluation.gate(n, fail_under=args.fail_under, fail_on_errors=args.fail_on_errors)


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    return args.handler(SparkSession.builder.appName("folioforge").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
