"""Providers of what only Python can read: PDF text, OCR and model extractions.

A provider is built once a task by a factory, sees one document at a time, and may fail: failures
become error records, never failed jobs. Model calls cost money, so their results are written
before anything reads them twice, keyed by the content's hash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import shutil
import subprocess
import tempfile
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.functions.fields import DOCUMENT_PATHS, ITEM_PATHS, TOTAL_PATHS
from folioforge.operators import quality
from folioforge.operators.candidates import reports
from folioforge.operators.grounding import validated_records
from folioforge.operators.summaries import field_histograms, token_usage
from folioforge.session import written
from folioforge.sources.files import append_traces

# Names of the steps in error records.
STEP_MODEL, STEP_TEXT, STEP_OCR, STEP_CANDIDATES, STEP_GROUNDING = "openai_pdf_extraction", "pymupdf_text_extraction", "optional_ocr", "regex_candidate_extraction", "candidate_validation"
# What the parts of a field may be.
STATUSES, CONFIDENCES = ("found", "unknown", "invalid"), ("high", "medium", "low", "unknown")
LANGUAGES, DPI, TIMEOUT_S = "eng+dan+deu", 300, 30


class TextProvider(Protocol):
    def read(self, name: str, content: bytes) -> tuple[int, str]:
        """Pages and the embedded text of the first."""


class OcrProvider(Protocol):
    def read(self, name: str, content: bytes) -> tuple[str, list[str]]:
        """Text and warnings."""


class ModelProvider(Protocol):
    name: str
    model: str
    effort: str
    prompt: str

    def extract(self, name: str, content: bytes) -> tuple[dict, dict | None]:
        """An extraction and the usage of the call."""


class PdfText:
    """Embedded text by PyMuPDF, where it is installed."""

    def read(self, name: str, content: bytes) -> tuple[int, str]:
        import pymupdf

        with pymupdf.open(stream=content, filetype="pdf") as document:
            return len(document), document[0].get_text("text") if len(document) else ""


class RecordedText:
    """Texts recorded earlier, by document name or by content."""

    def __init__(self, texts: dict[str, str]):
        self.texts = texts

    def read(self, name: str, content: bytes) -> tuple[int, str]:
        key = name if name in self.texts else hashlib.sha256(content).hexdigest()
        if key not in self.texts:
            raise ValueError(f"no recorded text for {name}")
        return 1, self.texts[key]


class TesseractOcr:
    """OCR of the first page by the Tesseract command."""

    def __init__(self, command: str = "tesseract", languages: str = LANGUAGES, dpi: int = DPI, timeout_s: int = TIMEOUT_S, render: Callable[[bytes, str, int], None] | None = None):
        self.command, self.languages, self.dpi, self.timeout_s, self.render = command, languages, dpi, timeout_s, render or self.page_image

    @staticmethod
    def page_image(content: bytes, target: str, dpi: int) -> None:
        import pymupdf

        with pymupdf.open(stream=content, filetype="pdf") as document:
            document[0].get_pixmap(dpi=dpi, alpha=False).save(target)

    def read(self, name: str, content: bytes) -> tuple[str, list[str]]:
        command = self.command if Path(self.command).is_file() else shutil.which(self.command)
        if not command:
            return "", ["ocr_unavailable:tesseract_not_found"]
        with tempfile.TemporaryDirectory() as folder:
            image = f"{folder}/page.png"
            self.render(content, image, self.dpi)
            done = subprocess.run([command, image, "stdout", "-l", self.languages], capture_output=True, text=True, timeout=self.timeout_s)
        if done.returncode:
            why = " ".join(done.stderr.split()) or f"exit_code_{done.returncode}"
            return "", [f"ocr_failed:{why[:300]}"]
        text = done.stdout.strip()
        return text, [] if text else ["ocr_returned_no_text"]


class ReplayedModel:
    """Extractions recorded earlier, by document name."""

    name, prompt = "replay", ""

    def __init__(self, extractions: dict[str, dict], usage: dict[str, int] | None = None, model: str = "recorded", effort: str = "minimal"):
        self.extractions, self.usage, self.model, self.effort = extractions, usage, model, effort

    def extract(self, name: str, content: bytes) -> tuple[dict, dict | None]:
        if name not in self.extractions:
            raise ValueError(f"no recorded extraction for {name}")
        return self.extractions[name], self.usage


PROMPT = """Read the attached invoice and answer with one JSON object that fits the given schema. Copy raw_value from the
document as it is printed and quote where it stands as evidence. Give amounts in normalized_value with a decimal point and two
places, dates as yyyy-mm-dd and currencies as three letters. Where the document does not state a value, leave it null and set
status to unknown. Never guess."""


def answer_schema() -> dict:
    """JSON schema of a model's answer."""
    text = {"type": ["string", "null"]}
    parts = {"raw_value": text, "normalized_value": text, "evidence": text, "status": {"enum": list(STATUSES)}, "confidence": {"enum": list(CONFIDENCES)}}

    def group(names: tuple[str, ...], part: dict, **more: dict) -> dict:
        properties = {n: part for n in names} | more
        return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}

    field = group(tuple(parts), {}) | {"properties": parts}
    return group(DOCUMENT_PATHS, field, totals=group(TOTAL_PATHS, field), line_items={"type": "array", "items": group(ITEM_PATHS, field)}, warnings={"type": "array", "items": {"type": "string"}})


class HttpModel:
    """A model behind an HTTP service that takes a file and a JSON schema; its key comes from the environment."""

    name, prompt = "openai", PROMPT

    def __init__(self, url: str, model: str, effort: str = "minimal", key_variable: str = "FOLIOFORGE_API_KEY", timeout_s: int = 120):
        self.url, self.model, self.effort, self.key_variable, self.timeout_s = url, model, effort, key_variable, timeout_s

    def request(self, name: str, content: bytes) -> dict:
        data = f"data:application/pdf;base64,{base64.b64encode(content).decode()}"
        parts = [{"type": "input_file", "filename": name, "file_data": data}, {"type": "input_text", "text": self.prompt}]
        schema = {"type": "json_schema", "name": "invoice", "schema": answer_schema(), "strict": True}
        return {"model": self.model, "reasoning": {"effort": self.effort}, "input": [{"role": "user", "content": parts}], "text": {"format": schema}}

    def extract(self, name: str, content: bytes) -> tuple[dict, dict | None]:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        asked = urllib.request.Request(self.url, json.dumps(self.request(name, content)).encode(), headers)
        with urllib.request.urlopen(asked, timeout=self.timeout_s) as reply:
            answer = json.load(reply)
        said = "".join(part.get("text", "") for item in answer.get("output", []) for part in item.get("content") or [])
        return json.loads(said), answer.get("usage")


def _now() -> str:
    return datetime.now(UTC).isoformat()


def read_texts(documents: DataFrame, text: Callable[[], TextProvider], ocr: Callable[[], OcrProvider] | None = None, *, scanned_below: int = quality.SCANNED, sparse_below: int = quality.SPARSE) -> tuple[DataFrame, DataFrame]:
    """(texts, errors) of documents (document_name, content). OCR only sees pages that look scanned.

    A column ``recorded`` of the documents, where there is one, holds texts that were read earlier; a document
    without one is an error. What was read is written once, as both results come from it.
    """
    given = "recorded" in documents.columns
    schema = "document_name string, pages int, embedded_text string, ocr_text string, ocr_warnings array<string>, reason string"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, scanner = text(), ocr() if ocr else None
        for frame in frames:
            rows = []
            for name, content, known in zip(frame["document_name"], frame["content"], frame["recorded"], strict=True):
                row: list = [name, None, None, None, None, None]
                try:
                    if given and known is None:
                        raise ValueError(f"no recorded text for {name}")
                    row[1], row[2] = (1, known) if given else reader.read(name, bytes(content))
                    if scanner and row[1] and len(row[2].strip()) < scanned_below:
                        row[3], row[4] = scanner.read(name, bytes(content))
                except Exception as error:  # one bad document must not fail the others
                    row = [name, None, None, None, None, str(error) or type(error).__name__]
                rows.append(row)
            yield pd.DataFrame(rows, columns=["document_name", "pages", "embedded_text", "ocr_text", "ocr_warnings", "reason"])

    asked = documents.select("document_name", "content", F.col("recorded") if given else F.lit(None).cast("string").alias("recorded"))
    found = written(asked.mapInPandas(work, schema), "texts")
    return quality.classify(found.where("reason is null"), scanned_below=scanned_below, sparse_below=sparse_below), found.where("reason is not null").select("document_name", "reason")


def errors_as_records(errors: DataFrame, steps: list[str]) -> DataFrame:
    return errors.select(F.lit("error").alias("record_type"), "document_name", "reason", F.array(*map(F.lit, steps)).alias("attempted_steps"))


def text_records(documents: DataFrame, text: Callable[[], TextProvider], ocr: Callable[[], OcrProvider] | None = None) -> DataFrame:
    """Text reports and error records."""
    texts, errors = read_texts(documents, text, ocr)
    good = texts.select(F.lit("pdf_text").alias("record_type"), "*")
    return good.unionByName(errors_as_records(errors, [STEP_TEXT]), allowMissingColumns=True)


def candidate_records(documents: DataFrame, text: Callable[[], TextProvider], ocr: Callable[[], OcrProvider] | None = None) -> DataFrame:
    """Candidate reports and error records."""
    texts, errors = read_texts(documents, text, ocr)
    return reports(texts).unionByName(errors_as_records(errors, [STEP_TEXT, STEP_CANDIDATES]), allowMissingColumns=True)


def check_extraction(found: dict) -> None:
    """Raise if a model's answer does not fit the schema of extractions; absent parts take their defaults."""

    def field(path: str, value) -> None:
        if value is None:
            return
        if not isinstance(value, dict):
            raise ValueError(f"{path} is not a field")
        for part in ("raw_value", "normalized_value", "evidence"):
            if not isinstance(value.get(part), str | None):
                raise ValueError(f"{path}.{part} is not a text")
        for part, allowed in (("status", STATUSES), ("confidence", CONFIDENCES)):
            if value.get(part) is not None and value[part] not in allowed:
                raise ValueError(f"{path}.{part} is not one of {', '.join(allowed)}")

    def group(path: str, value, names: tuple[str, ...]) -> None:
        if value is not None and not isinstance(value, dict):
            raise ValueError(f"{path} is not an object")
        for name in names:
            field(f"{path}.{name}".lstrip("."), (value or {}).get(name))

    group("", found, DOCUMENT_PATHS)
    group("totals", found.get("totals"), TOTAL_PATHS)
    for name in ("line_items", "warnings"):
        if not isinstance(found.get(name), list | None):
            raise ValueError(f"{name} is not a list")
    for k, item in enumerate(found.get("line_items") or []):
        group(f"line_items[{k}]", item, ITEM_PATHS)
    if not all(isinstance(w, str) for w in found.get("warnings") or []):
        raise ValueError("a warning is not a text")


def call_model(documents: DataFrame, model: Callable[[], ModelProvider], *, concurrency: int | None = None) -> DataFrame:
    """document_name, extraction (JSON), reason and trace of each document; write before reading twice.

    A column ``recorded`` of the documents, where there is one, holds extractions made earlier, as JSON.
    Extractions that do not fit the schema are errors.
    """
    given = "recorded" in documents.columns
    schema = f"document_name string, extraction_json string, reason string, trace struct<{', '.join(f.replace(' ', ': ', 1) for f in _fields(schemas.TRACE))}>"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = model()
        for frame in frames:
            rows = []
            for name, content, known in zip(frame["document_name"], frame["content"], frame["recorded"], strict=True):
                data, began, clock = bytes(content), _now(), time.perf_counter()
                extraction = usage = reason = error = None
                try:
                    if given and known is None:
                        raise ValueError(f"no recorded extraction for {name}")
                    found, usage = (json.loads(known), None) if given else provider.extract(name, data)
                    if not isinstance(found, dict):
                        raise ValueError("the extraction is not an object")
                    check_extraction(found)
                    extraction = json.dumps({**found, "document_name": name, "extraction_method": f"{provider.name}_pdf:{provider.model}:reasoning_{provider.effort}"}, ensure_ascii=False)
                except Exception as problem:  # one bad document must not fail the others
                    reason = str(problem) or type(problem).__name__
                    error = {"type": type(problem).__name__, "message": str(problem)[:300]}
                summary = {"file_name": name, "file_type": "application/pdf", "file_bytes": len(data), "file_sha256": hashlib.sha256(data).hexdigest(), "prompt_chars": len(provider.prompt)}
                trace = {"trace_id": str(uuid.uuid4()), "record_type": "trace", "event_type": "llm_call", "step": STEP_MODEL, "document_name": name, "provider": provider.name, "model": provider.model, "reasoning_effort": provider.effort, "started_at": began, "ended_at": _now(), "status": "error" if error else "success", "input_summary": summary, "latency_ms": round(1000 * (time.perf_counter() - clock)), "usage": None if usage is None else {k: v for k, v in usage.items() if isinstance(v, int)}, "output_summary": None, "error": error}
                rows.append([name, extraction, reason, trace])
            yield pd.DataFrame(rows, columns=["document_name", "extraction_json", "reason", "trace"])

    rows = documents.select("document_name", "content", F.col("recorded") if given else F.lit(None).cast("string").alias("recorded"))
    return (rows.repartition(concurrency) if concurrency else rows).mapInPandas(work, schema)


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, begin = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[begin:k].strip())
            begin = k + 1
    return [*out, ddl[begin:].strip()]


def full_extraction(extraction_json):
    """The extraction with defaults: unknown status and confidence, empty lists."""
    raw = F.from_json(extraction_json, schemas.EXTRACTION)

    def field(f):
        get = f.getField
        unknown = F.lit("unknown")
        return F.struct(get("raw_value").alias("raw_value"), get("normalized_value").alias("normalized_value"), get("evidence").alias("evidence"), F.coalesce(get("status"), unknown).alias("status"), F.coalesce(get("confidence"), unknown).alias("confidence"))

    totals = F.struct(*[field(raw["totals"][p]).alias(p) for p in TOTAL_PATHS]).alias("totals")
    items = F.coalesce(F.transform(raw["line_items"], lambda item: F.struct(*[field(item[p]).alias(p) for p in ITEM_PATHS])), F.array().cast(f"array<{schemas.ITEM}>")).alias("line_items")
    own = [field(raw[p]).alias(p) for p in DOCUMENT_PATHS]
    return F.struct(raw["document_name"].alias("document_name"), raw["extraction_method"].alias("extraction_method"), *own, totals, items, F.coalesce(raw["warnings"], F.array().cast("array<string>")).alias("warnings"))


def extraction_records(documents: DataFrame, calls: DataFrame, text: Callable[[], TextProvider], ocr: Callable[[], OcrProvider] | None = None) -> DataFrame:
    """Validated records and error records from written model calls and the documents' texts.

    The model comes first, so a document that fails there has only that step attempted.
    """
    texts, unread = read_texts(documents, text, ocr)
    good = calls.where("reason is null").select("document_name", full_extraction(F.col("extraction_json")).alias("extraction"))
    failed = errors_as_records(calls.where("reason is not null").select("document_name", "reason"), [STEP_MODEL])
    steps = [STEP_MODEL, STEP_TEXT] + [STEP_OCR] * bool(ocr)
    late = errors_as_records(unread.join(good.select("document_name"), "document_name", "left_semi"), steps)
    return validated_records(good, texts).unionByName(failed, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)


def traces(calls: DataFrame) -> DataFrame:
    """Traces of written model calls, with summaries of usage and output."""
    t = F.col("trace")
    summary = F.when(F.col("extraction_json").isNotNull(), field_histograms(full_extraction(F.col("extraction_json"))))
    return calls.select(t.withField("usage", token_usage(t["usage"])).withField("output_summary", summary).alias("t")).select("t.*")


@dataclass(frozen=True)
class PipelineConfig:
    """What a run of the extraction pipeline uses; providers are built once a task."""

    model: Callable[[], ModelProvider]
    text: Callable[[], TextProvider] = PdfText
    ocr: Callable[[], OcrProvider] | None = None
    trace_out: str | None = None
    concurrency: int | None = None


@dataclass(frozen=True)
class PipelineRun:
    records: DataFrame
    traces: DataFrame


def run_pipeline(documents: DataFrame, config: PipelineConfig, recorded: DataFrame | None = None) -> PipelineRun:
    """Model calls, texts, candidates and grounding of all documents; traces are appended to the configured folder.

    ``recorded`` (document_name, recorded) has extractions made earlier, which then stand for the model's.
    """
    asked = documents.drop("recorded")
    if recorded is not None:
        asked = asked.join(recorded.dropDuplicates(["document_name"]), "document_name", "left")
    calls = written(call_model(asked, config.model, concurrency=config.concurrency), "calls")
    append_traces(traces(calls), config.trace_out)
    return PipelineRun(extraction_records(documents, calls, config.text, config.ocr), traces(calls))
