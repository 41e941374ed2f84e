"""Readers, writers, providers, commands and streaming."""

import http.server
import json
import threading

import pytest

from folioforge import cli
from folioforge.sources import files, providers
from folioforge.streaming import ingest
from tests.test_operators import bank, extraction, validated


def test_bank_csv(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text('txn_id,date,amount,counterparty,reference,category\nT1,2026-01-01,"-1.234,50","he said ""hi""",ref,\nT2,2026-01-02,n/a,x,y,z\nT3,2026-01-03,5\n', encoding="utf-8")
    rows = files.read_bank(spark, str(path)).orderBy("bank_pos").collect()
    assert [(r.txn_id, str(r.amount), r.raw_amount, r.counterparty, r.category) for r in rows] == [("T1", "1234.50", "-1.234,50", 'he said "hi"', ""), ("T3", "5.00", "5", "", "")]


def test_records_round_trip(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text(json.dumps(validated(invoice_id="ÆØ-1")) + "\n\n", encoding="utf-8")
    rows = files.read_records(spark, str(path))
    files.write_records(rows, str(tmp_path / "out"), order_by="document_name", single_file=True)
    text = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    assert '"reason":null' in text and "ÆØ-1" in text
    path.write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_records(spark, str(path)).collect()


def test_golden_is_checked(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    for lines, problem in (("", "empty"), ('{"document_name":"","expected":{}}', "name its document"), ('{"document_name":"a","expected":[1]}', "expected values"), ("{oops", "name its document")):
        path.write_text(lines + "\n")
        with pytest.raises(ValueError, match=problem):
            files.read_golden(spark, str(path))
    path.write_text('{"document_name":"a.pdf","expected":{"line_items":[{"quantity":6}]}}\n')
    assert files.read_golden(spark, str(path)).first().expected == '{"line_items":[{"quantity":6}]}'


@pytest.fixture
def pdfs(tmp_path):
    folder = tmp_path / "pdfs"
    folder.mkdir()
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (folder / name).write_bytes(f"%PDF {name}".encode())
    (folder / "notes.txt").write_text("no")
    (tmp_path / "texts.jsonl").write_text("\n".join(json.dumps({"document_name": n, "text": t}) for n, t in (("a.pdf", "Invoice INV-1001\nTotal 100,00 DKK\n" + "word " * 40), ("b.pdf", "x"))))
    (tmp_path / "model.jsonl").write_text("\n".join(json.dumps(extraction(n, invoice_id="INV-1001", supplier_name="Acme", currency="DKK", total_amount="100.00")) for n in ("a.pdf", "c.pdf")))
    return tmp_path


def lines(path):
    return {r["document_name"]: r for f in path.glob("part-*") for r in map(json.loads, f.read_text().splitlines())}


def test_commands(spark, pdfs, capsys):
    common = [str(pdfs / "pdfs"), "--texts", str(pdfs / "texts.jsonl"), "--tesseract-cmd", "no-such-command"]
    assert cli.main(["inspect-text", *common, "--out", str(pdfs / "t")]) == 0
    got = lines(pdfs / "t")
    assert set(got) == {"a.pdf", "b.pdf", "c.pdf"} and got["c.pdf"]["attempted_steps"] == ["pymupdf_text_extraction"]
    assert got["b.pdf"]["warnings"] == ["embedded_text_is_too_sparse", "ocr_attempted", "ocr_unavailable:tesseract_not_found"]
    assert cli.main(["inspect-candidates", *common, "--out", str(pdfs / "c")]) == 0
    assert lines(pdfs / "c")["a.pdf"]["id_candidates"][0]["normalized_value"] == "INV-1001"
    assert cli.main(["extract", *common, "--model-replay", str(pdfs / "model.jsonl"), "--trace-out", str(pdfs / "traces"), "--out", str(pdfs / "e")]) == 0
    got = lines(pdfs / "e")
    assert got["a.pdf"]["record_type"] == "validated_extraction" and [f["field_path"] for f in got["a.pdf"]["valid_fields"]] == ["invoice_id", "currency", "totals.total_amount"]
    assert got["b.pdf"]["attempted_steps"] == ["openai_pdf_extraction"] and got["c.pdf"]["attempted_steps"] == ["openai_pdf_extraction", "pymupdf_text_extraction", "optional_ocr"]
    traces = lines(pdfs / "traces")
    assert traces["a.pdf"]["output_summary"]["field_status_counts"] == {"found": 4, "unknown": 7} and traces["b.pdf"]["error"]["type"] == "ValueError"
    (pdfs / "bank.csv").write_text("txn_id,date,amount,counterparty,reference,category\nT1,2026-01-01,-100.00,ACME,inv-1001,x\n")
    assert cli.main(["triage", "--extractions", str(pdfs / "e"), "--bank", str(pdfs / "bank.csv"), "--out", str(pdfs / "d")]) == 0
    got = lines(pdfs / "d")
    assert got["a.pdf"]["outcome"] == "auto_accept" and got["b.pdf"]["outcome"] == "reject"
    (pdfs / "g.jsonl").write_text(json.dumps({"document_name": "a.pdf", "expected": {"invoice_id": "INV-1001", "supplier_name": "Other"}}))
    evaluate = ["evaluate", "--golden", str(pdfs / "g.jsonl"), "--extractions", str(pdfs / "e"), "--out", str(pdfs / "r")]
    assert cli.main(evaluate) == 0 and cli.main([*evaluate, "--fail-under", "0.9"]) == 1
    said = capsys.readouterr().out
    assert "Processed 3 files: 2 text reports, 1 scanned-like, 0 OCR, 1 errors." in said
    assert "Triaged 3 invoices: 1 auto-accept, 0 review, 2 reject." in said and "1/2 correct fields, 50.0% accuracy" in said
    assert cli.main([]) == 0
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_ocr_command(tmp_path):
    command = tmp_path / "ocr.sh"
    command.write_text("#!/bin/sh\necho ' Invoice OCR-123'\n")
    command.chmod(0o755)
    render = lambda content, target, dpi: open(target, "wb").close()
    assert providers.TesseractOcr(str(command), render=render).read("a", b"") == ("Invoice OCR-123", [])
    command.write_text("#!/bin/sh\necho bad >&2; exit 3\n")
    assert providers.TesseractOcr(str(command), render=render).read("a", b"") == ("", ["ocr_failed:bad"])
    command.write_text("#!/bin/sh\nexit 0\n")
    assert providers.TesseractOcr(str(command), render=render).read("a", b"") == ("", ["ocr_returned_no_text"])


def test_streamed_records_are_routed_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = json.dumps(validated("a.pdf", invoice_id="INV-1001", supplier_name="Acme", currency="DKK", total_amount="100.00"))
    payments = bank(spark, ("-100.00", "ACME", "inv-1001"))
    for name, text in (("1.jsonl", f"{line}\n{line}\n"), ("2.jsonl", line + "\n" + json.dumps({"record_type": "error", "document_name": "e.pdf"}) + "\n")):
        (folder / name).write_text(text)
        ingest.route_stream(spark, str(folder), payments, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.document_name, r.outcome) for r in rows) == [("a.pdf", "auto_accept"), ("e.pdf", "reject")]


class Service(http.server.BaseHTTPRequestHandler):
    asked: list[dict] = []

    def do_POST(self):
        Service.asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))) | {"key": self.headers["Authorization"]})
        answer = {"output": [{"type": "reasoning"}, {"content": [{"text": json.dumps({"invoice_id": {"raw_value": "INV-1", "status": "found"}})}]}], "usage": {"input_tokens": 3}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *args):
        pass


def test_model_service(monkeypatch):
    monkeypatch.setenv("FOLIOFORGE_API_KEY", "k")
    with http.server.HTTPServer(("127.0.0.1", 0), Service) as server:
        thread = threading.Thread(target=server.serve_forever)
        thread.start()
        found, usage = providers.HttpModel(f"http://127.0.0.1:{server.server_port}/", "m", "low").extract("a.pdf", b"%PDF")
        server.shutdown()
        thread.join()
    assert found["invoice_id"]["raw_value"] == "INV-1" and usage == {"input_tokens": 3}
    providers.check_extraction(found)
    (asked,) = Service.asked
    assert asked["key"] == "Bearer k" and asked["input"][0]["content"][0]["file_data"] == "data:application/pdf;base64,JVBERg=="
    schema = asked["text"]["format"]["schema"]
    assert set(schema["properties"]) >= {"invoice_id", "totals", "line_items"} and schema["properties"]["invoice_id"]["properties"]["status"]["enum"] == ["found", "unknown", "invalid"]


@pytest.mark.parametrize(("answer", "problem"), [({"invoice_id": "x"}, "invoice_id is not a field"), ({"totals": []}, "totals is not an object"), ({"totals": {"discount": {"status": "maybe"}}}, "totals.discount.status"), ({"line_items": {}}, "line_items is not a list"), ({"line_items": [{"name": {"raw_value": 5}}]}, r"line_items\[0\].name.raw_value"), ({"warnings": [1]}, "a warning")])
def test_answers_are_checked(answer, problem):
    with pytest.raises(ValueError, match=problem):
        providers.check_extraction(answer)


def test_golden_problems_name_the_line(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('\n{"document_name":"a","expected":{}}\n\n{"document_name":"","expected":{}}\n')
    with pytest.raises(ValueError, match="line 4"):
        files.read_golden(spark, str(path))


def test_evaluation_from_pdf_files(spark, pdfs, capsys):
    (pdfs / "g.jsonl").write_text(json.dumps({"document_name": "a.pdf", "expected": {"invoice_id": "INV-1001"}}))
    run = ["evaluate", "--golden", str(pdfs / "g.jsonl"), "--out", str(pdfs / "r"), "--texts", str(pdfs / "texts.jsonl"), "--no-ocr"]
    assert cli.main([*run, "--pdf-dir", str(pdfs / "pdfs"), "--model-replay", str(pdfs / "model.jsonl")]) == 0
    assert "1/1 correct fields" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(run)
