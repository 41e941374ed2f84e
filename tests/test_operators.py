"""Candidates, grounding, triage and evaluation on small documents."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.functions.fields import DOCUMENT_PATHS, ITEM_PATHS, TOTAL_PATHS
from folioforge.functions.similarity import token_set_ratio
from folioforge.operators import alignment, evaluation, grounding, matching, quality, routing, summaries
from folioforge.operators.candidates import NO_TEXT, extract_candidates
from folioforge.sources.files import bank_rows


def found(spark, text):
    return spark.createDataFrame([("d.pdf", text)], "document_name string, text string").transform(extract_candidates).first().candidates


def test_danish_text(spark):
    c = found(spark, "Nordic Steel\nFaktura NS-2026-0431\nDato 2026-04-02\nForfald 02.05.2026\nNetto 9.960,00 DKK\nMoms 25%\nTotal 12.450,00 DKK")
    assert "NS-2026-0431" in [x.normalized_value for x in c.id_candidates]
    assert [str(x.normalized_value) for x in c.dates] == ["2026-04-02", "2026-05-02"]
    assert [x.normalized_value for x in c.currencies] == ["DKK"]
    assert [x.normalized_value for x in c.tax_percentages] == [Decimal("25.00")]
    amounts = {x.normalized_value: x for x in c.amounts}
    assert Decimal("12450.00") in amounts and amounts[Decimal("12450.00")].currency == "DKK" and {x.role for x in c.amounts} == {"unknown"}


@pytest.mark.parametrize(
    ("text", "ids"),
    [("Rechnung RE-2026-339, Lieferschein LS-5680, Auftrag au-2026-4773", ["RE-2026-339", "LS-5680", "AU-2026-4773"]), ("PO-98765 and PO-44521 and PO-98765", ["PO-98765", "PO-44521"]), ("Order 2026-0488; INV-44280 HD-450", ["2026-0488", "INV-44280", "HD-450"]), ("nothing", [])],
)
def test_ids(spark, text, ids):
    assert [x.normalized_value for x in found(spark, text).id_candidates] == ids


def test_blank_text_and_zeros(spark):
    for text in (None, "", "  \n"):
        c = found(spark, text)
        assert c.warnings == [NO_TEXT] and not c.amounts and not c.id_candidates
    assert [x.raw_value for x in found(spark, "0,00 and 0.00 and 0,00").amounts] == ["0,00", "0.00"]
    assert [x.normalized_value for x in found(spark, "Late fee 2%, VAT 25%, 25,00 %").tax_percentages] == [Decimal("2.00"), Decimal("25.00")]


def test_currency_comes_from_around(spark):
    text = "EUR " + "x" * 60 + " 12,00 " + "y" * 200 + " 13,00 øre12,00"
    assert [(x.raw_value, x.currency) for x in found(spark, text).amounts] == [("12,00", "EUR"), ("13,00", None)]


def field(value=None, status=None, confidence="high"):
    return {"raw_value": value, "normalized_value": value, "evidence": None, "status": status or ("unknown" if value is None else "found"), "confidence": confidence if value is not None else "unknown"}


def extraction(name="invoice.pdf", items=(), **values):
    own = {p: field(values.get(p)) for p in DOCUMENT_PATHS}
    totals = {p: field(values.get(p)) for p in TOTAL_PATHS}
    return {"document_name": name, "extraction_method": "test", **own, "totals": totals, "line_items": [{p: field(i.get(p)) for p in ITEM_PATHS} for i in items], "warnings": []}


def records(spark, *rows):
    lines = [json.dumps(r) for r in rows]
    return spark.createDataFrame([(x,) for x in lines], "v string").select(F.from_json("v", ", ".join([schemas.RECORD])).alias("r")).select("r.*")


def validated(name="invoice.pdf", valid=("invoice_id", "currency", "totals.total_amount"), invalid=(), **values):
    paths = lambda ps: [{"field_path": p, "reason": "r"} for p in ps]
    return {"record_type": "validated_extraction", "document_name": name, "extraction": extraction(name, **values), "valid_fields": paths(valid), "invalid_fields": paths(invalid), "unchecked_fields": [], "candidate_warnings": [], "source_warnings": []}


def bank(spark, *rows):
    return bank_rows(spark.createDataFrame([(f"T{k}", "2026-04-01", a, c, r, "x", k) for k, (a, c, r) in enumerate(rows)], "txn_id string, date string, amount string, counterparty string, reference string, category string, bank_pos long"))


def decide(spark, record, *payments):
    return routing.triage(records(spark, record), bank(spark, *payments)).first()


SCENES = [
    (("2026-0488", "København Logistik ApS", "4200.00"), ("-4200.00", "KBH LOGISTIK", "Inv 2026-0488 transport"), ("auto_accept", "clean", "high", [])),
    (("SVS-2026-104", "Skandinavisk El & VVS", "3450.00"), ("-3450.00", "SKAN EL VVS A/S", "SVS-2026-104"), ("auto_accept", "clean", "medium", [])),
    (("RE-2026-1198", "Berliner Maschinenbau GmbH", "8750.00"), ("-8750.00", "Berliner Maschinenbau", "Rechnung 2026-1198"), ("auto_accept", "clean", "high", [])),
    (("RE-2026-1198", "Berliner Maschinenbau GmbH", "8750.00"), ("-8750.00", "BERLINER MASCH", "Rechnung 2026-1198"), ("review", "questionable", "medium", ["invoice_id_missing_from_bank_reference", "supplier_fuzzy_match_medium:0.73", "match_status_questionable"])),
    (("GOS-99421", "Global Office Supplies Ltd", "1875.40"), ("-1837.89", "GLOBAL OFFICE SUPP", "GOS-99421 early payment -2%"), ("review", "questionable", "high", ["amount_mismatch_requires_review", "match_status_questionable"])),
    (("INV-404", "Missing Match Supplier", "100.00"), ("-999.00", "Other Party", "Other invoice"), ("review", "none", None, ["no_plausible_bank_match"])),
    (("INV-1", "Same Name", "100.00"), ("-999.00", "SAME NAME", "other"), ("review", "questionable", "high", ["invoice_id_missing_from_bank_reference", "amount_mismatch_requires_review", "match_status_questionable"])),
]


@pytest.mark.parametrize(("invoice", "payment", "expected"), SCENES)
def test_triage_scenes(spark, invoice, payment, expected):
    number, name, total = invoice
    d = decide(spark, validated(invoice_id=number, supplier_name=name, currency="DKK", total_amount=total), payment)
    supplier = d.matched_transactions[0].signal_checks.supplier.status if d.matched_transactions else None
    assert (d.outcome, d.match_status, supplier, d.reasons) == expected
    assert d.invoice_amount == total and d.extraction_confidence == "high"


def test_triage_without_payments_and_of_other_records(spark):
    good = validated(invoice_id="INV-1", supplier_name="A", currency="DKK", total_amount="1.00")
    failed = {"record_type": "error", "document_name": "e.pdf", "reason": "model failed", "attempted_steps": ["s"]}
    rows = {r.document_name: r for r in routing.triage(records(spark, good, failed, {"record_type": "draft", "document_name": "d.pdf"}, {"document_name": "n.pdf"}), bank(spark).limit(0)).collect()}
    assert (rows["invoice.pdf"].outcome, rows["invoice.pdf"].reasons) == ("review", ["no_plausible_bank_match"])
    assert (rows["e.pdf"].reasons, rows["e.pdf"].extraction_error.reason, rows["e.pdf"].extraction_error.attempted_steps) == (["extraction_failed"], "model failed", ["s"])
    assert rows["d.pdf"].reasons == ["unsupported_extraction_record_type:draft"] and rows["d.pdf"].extraction_error is None
    assert rows["n.pdf"].reasons == ["unsupported_extraction_record_type:None"]


REJECTED = [
    (dict(invoice_id=None), (), ["missing_invoice_id"]),
    (dict(currency="GBP"), (), ["missing_currency"]),
    (dict(), ("invoice_id", "currency"), ["critical_field_failed_validation:currency,invoice_id"]),
    (dict(pre_tax_amount="80.00", tax_amount="25.00"), (), ["total_integrity_failed"]),
    (dict(supplier_name=None, total_amount=None), (), ["missing_supplier_name", "missing_total_amount"]),
]


@pytest.mark.parametrize(("changes", "invalid", "reasons"), REJECTED)
def test_rejections_keep_their_matches(spark, changes, invalid, reasons):
    values = dict(invoice_id="INV-1001", supplier_name="Acme", currency="DKK", total_amount="100.00") | changes
    d = decide(spark, validated(invalid=invalid, **values), ("-100.00", "Acme", "INV-1001"))
    assert (d.outcome, d.extraction_confidence, d.reasons) == ("reject", "low", reasons)
    assert bool(d.matched_transactions) == (values["total_amount"] is not None and (values["invoice_id"] is not None or values["supplier_name"] is not None))


def test_close_matches_ties_and_top_three(spark):
    record = validated(valid=("invoice_id",), invoice_id="INV-1001", supplier_name="Acme Steel", currency="DKK", total_amount="100.00")
    d = decide(spark, record, ("-500.00", "Acme Steel", "z"), ("-100.00", "Acme Steel", "inv 1001"), ("-100.50", "Acme Steel", "x"), ("-101.01", "Acme Steel", "INV-1001"), ("-100.00", "Acme Steel", "y"), ("bad", "Acme Steel", "INV-1001"))
    assert [t.txn_id for t in d.matched_transactions] == ["T3", "T1", "T2"]
    assert d.reasons == ["critical_candidate_validation_missing:currency,totals.total_amount", "amount_mismatch_requires_review", "extraction_confidence_below_auto_accept_threshold"]
    d = decide(spark, record, ("-100.00", "Acme Steel", "a"), ("-100.00", "Acme Steel", "b"))
    assert "multiple_candidate_matches" in d.reasons and [t.txn_id for t in d.matched_transactions] == ["T0", "T1"]


def test_partitioning_changes_nothing(spark):
    rows = [validated(f"{k}.pdf", invoice_id=f"INV-{k}", supplier_name=f"Firm {'ABCDEFGH'[k % 8] * 5}", currency="DKK", total_amount=f"{100 + k % 7}.00") for k in range(100, 160)]
    payments = bank(spark, *[(f"-{100 + k % 5}.00", f"{'ABCDEFGH'[k % 8] * 5} firm", f"ref INV-{k}") for k in range(120, 150)])
    one = routing.triage(records(spark, *rows).coalesce(1), payments).drop("rec_id")
    many = routing.triage(records(spark, *rows).repartition(7, "document_name"), payments.repartition(5)).drop("rec_id")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_grounding(spark):
    text = "Invoice NS-2026-0431 dated 2026-04-02\nTotal 12.450,00 DKK incl. 25%"
    row = extraction(invoice_id="ns-2026-0431 ", invoice_date="2026-04-99", total_amount="12450.00", supplier_name="Nordic", currency="USD", items=[{"name": "x", "amount": "9.99", "currency": "DKK"}])
    rows = records(spark, {"document_name": "d.pdf", "extraction": row}).select("document_name", "extraction").join(spark.createDataFrame([("d.pdf", text)], "document_name string, text string").transform(extract_candidates).select("document_name", "candidates"), "document_name")
    r = grounding.ground(rows).first()
    assert [f.field_path for f in r.valid_fields] == ["invoice_id", "totals.total_amount", "line_items[0].currency"]
    assert [(f.field_path, f.reason) for f in r.invalid_fields] == [("currency", "normalized_value_not_found_in_candidates"), ("invoice_date", "value_failed_normalization"), ("line_items[0].amount", "normalized_value_not_found_in_candidates")]
    assert [f.field_path for f in r.unchecked_fields] == ["po_reference", "due_date", "totals.pre_tax_amount", "totals.tax_percentage", "totals.tax_amount", "totals.discount", "supplier_name", "line_items[0].name", "line_items[0].quantity"]
    assert r.valid_fields[0].matched_candidate == "NS-2026-0431"


def test_quality(spark):
    rows = [("a.pdf", 1, "x" * 200, None, None), ("b.pdf", 1, " " + "x" * 50, None, None), ("c.pdf", 1, "tiny", "OCR text that is long", []), ("d.txt", 0, None, None, None), ("e.pdf", 1, "", "", ["ocr_returned_no_text"])]
    got = {r.document_name: r for r in quality.classify(spark.createDataFrame(rows, "document_name string, pages int, embedded_text string, ocr_text string, ocr_warnings array<string>")).collect()}
    assert got["a.pdf"].warnings == [] and got["a.pdf"].text_source == "embedded_text"
    assert got["b.pdf"].warnings == ["embedded_text_may_be_incomplete"] and got["b.pdf"].character_count == 50
    assert (got["c.pdf"].text_source, got["c.pdf"].looks_scanned, got["c.pdf"].warnings) == ("ocr", True, ["embedded_text_is_too_sparse", "ocr_attempted", "ocr_text_used"])
    assert got["d.txt"].warnings == ["file_extension_is_not_pdf", "pdf_has_no_content"]
    assert (got["e.pdf"].text_source, got["e.pdf"].warnings) == ("none", ["no_embedded_text_found", "ocr_attempted", "ocr_returned_no_text"])


def golden(spark, **documents):
    return spark.createDataFrame([(k.replace("_", "."), json.dumps(v)) for k, v in documents.items()], "document_name string, expected string")


def outcomes(results):
    return {r.field_path: (r.outcome, r.reason) for r in results.collect()}


def test_evaluation_outcomes(spark):
    expected = {"invoice_id": "inv-1", "supplier_name": "Nordic Steel A/S", "currency": "kr.", "invoice_date": "02.04.2026", "due_date": None, "po_reference": "PO-1", "totals": {"pre_tax_amount": None, "tax_percentage": "25%", "tax_amount": "abc", "discount": 0, "total_amount": "100,00"}, "line_items": []}
    record = validated("a.pdf", invoice_id="INV-1", supplier_name="nordic steel as", currency="DKK", invoice_date="bad", due_date="2026-01-01", pre_tax_amount="5.00", tax_percentage="25", total_amount="100.01")
    got = outcomes(evaluation.field_results(golden(spark, a_pdf=expected), records(spark, record)))
    assert got == {
        "invoice_id": ("correct", "values_match"),
        "supplier_name": ("correct", "values_match"),
        "currency": ("correct", "values_match"),
        "invoice_date": ("hallucination", "prediction_failed_normalization"),
        "due_date": ("hallucination", "expected_missing_but_prediction_found"),
        "po_reference": ("miss", "expected_value_but_prediction_unknown"),
        "totals.pre_tax_amount": ("hallucination", "expected_zero_value_but_prediction_nonzero"),
        "totals.tax_percentage": ("correct", "values_match"),
        "totals.tax_amount": ("label_error", "expected_value_failed_normalization"),
        "totals.discount": ("correct", "values_match"),
        "totals.total_amount": ("hallucination", "values_differ"),
    }


def test_missing_documents_and_labels(spark):
    labels = golden(spark, a_pdf={"invoice_id": "X", "totals": {"total_amount": 0}}, b_pdf={"invoice_id": "Y", "line_items": {"not": "a list"}})
    record = validated("b.pdf", invoice_id="Y", items=[{"name": "n"}])
    results, documents = evaluation.field_results(labels, records(spark, record)), evaluation.document_results(labels, records(spark, record))
    assert {(r.document_name, r.field_path, r.outcome) for r in results.collect()} == {("a.pdf", "invoice_id", "miss"), ("a.pdf", "totals.total_amount", "correct"), ("b.pdf", "invoice_id", "correct")}
    rows = {r.document_name: r for r in documents.collect()}
    assert rows["a.pdf"].extraction_error.reason == "PDF not found: a.pdf" and "missing_expected_field:line_items" in rows["a.pdf"].label_warnings
    assert "invalid_expected_field:line_items_must_be_list" in rows["b.pdf"].label_warnings and rows["b.pdf"].candidate_validation.valid_fields == 3
    total = evaluation.summary(results, documents).first()
    assert (total.total, total.correct, total.misses, total.documents, total.extraction_errors) == (3, 2, 1, 2, 1)
    assert evaluation.gate(total, fail_under=0.7) == 1 and evaluation.gate(total, fail_under=0.5) == 0 and evaluation.gate(total, fail_on_errors=True) == 1
    assert evaluation.summary(results.limit(0)).first().accuracy == 0.0
    nested = evaluation.nested(results, documents).where("document_name = 'a.pdf'").first()
    assert [f.field_path for f in nested.field_results] == ["invoice_id", "totals.total_amount"]


def test_line_items(spark):
    labels = golden(spark, a_pdf={"line_items": [{"name": "Steel beams", "quantity": 2, "amount": "10"}, {"name": "Bolts", "quantity": None, "amount": "5"}, {"name": "Nuts"}]})
    record = validated("a.pdf", items=[{"name": "bolts", "amount": "5.00"}, {"name": "steel beam", "quantity": "2", "amount": "10.00"}, {"name": "zzzz", "amount": "7"}, {}])
    rows = evaluation.field_results(labels, records(spark, record)).orderBy("ord").collect()
    got = {r.field_path: r.outcome for r in rows}
    assert got == {"line_items[0].name": "correct", "line_items[0].quantity": "correct", "line_items[0].amount": "correct", "line_items[1].name": "correct", "line_items[1].quantity": "correct", "line_items[1].amount": "correct", "line_items[2].name": "miss", "line_items.extra[2]": "hallucination"}
    assert rows[-1].predicted == "name=zzzz; amount=7" and rows[0].metric_key == "line_items[].name"


def test_alignment_is_greedy_and_first_wins():
    item = lambda n, a: {"name": n, "quantity": None, "amount": a, "currency": None, "has_name": True, "has_quantity": False, "has_amount": True, "has_currency": False}
    assert alignment.assign([item("a", "1"), item("b", "1")], [item("q", "1"), item("a", "1"), item("q", "1")]) == [1, 0]
    assert alignment.assign([item("a", "1")], [item("q", "2")]) == [-1] and alignment.assign([], []) == []


def test_summaries(spark):
    rows = records(spark, validated(invalid=("currency",), invoice_id="A", items=[{"name": "x"}]), {"record_type": "error", "document_name": "e"})
    assert tuple(summaries.extraction_counts(rows).first()) == (2, 1, 1, 1)
    h = rows.where("record_type = 'validated_extraction'").select(summaries.field_histograms(F.col("extraction")).alias("h")).first().h
    assert h.field_status_counts == {"found": 2, "unknown": 13} and h.line_item_count == 1
    assert tuple(summaries.outcome_counts(spark.createDataFrame([("review",), ("review",)], "outcome string")).first()) == (2, 0, 2, 0)


@pytest.mark.parametrize("least", [50, 75])
def test_names_alike_equals_all_pairs(least):
    draw = random.Random(6)
    words = ["NORDIC", "STEEL", "STEAL", "A", "S", "GMBH", "KOBENHAVN", "KOBENHAVNS", "LOGISTIK", "EL", "VVS", "X" * 300]
    names = sorted({" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(160)} | {"", "NORDIC NORDIC", "Z"})
    left, right = names[::2], names[1::2] + names[:10]
    got = sorted(matching.alike(matching.Names(left), matching.Names(right), least))
    assert got == sorted((a, b, r) for a in left for b in right if (r := token_set_ratio(a, b)) >= least) and got
    assert matching.alike(matching.Names([]), matching.Names(right), least) == []


def test_unsupported_records_fail_the_evaluation(spark):
    golden = spark.createDataFrame([("a.pdf", "{}")], "document_name string, expected string")
    draft = records(spark, {"record_type": "draft", "document_name": "a.pdf"})
    with pytest.raises(Exception, match="unsupported record type: draft"):
        evaluation.field_results(golden, draft).collect()
