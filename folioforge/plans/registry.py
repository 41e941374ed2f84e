"""Registered queries of the document operators over the driver's tables, with DuckDB SQL.

The SQL does not repeat the operators' steps: inputs are made by rules, so it states what must come
out. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import numbers, text
from folioforge.functions.similarity import similarity
from folioforge.operators import candidates, evaluation, grounding, matching, quality, routing, summaries
from folioforge.plans import inputs
from folioforge.sources import files

FLAGSHIP = "triage_decisions"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common parts of the SQL: orders as inputs.orders has them, and money as text.
ORDERS = "o AS (SELECT o_orderkey AS k, greatest(CAST(round(o_totalprice * 100) AS BIGINT), 100) AS c, CAST(o_orderdate AS DATE) AS day, repeat(chr(CAST(65 + o_custkey % 26 AS INTEGER)), 8) AS party FROM orders)"
MONEY = "CAST(CAST({0} // 100 AS BIGINT) AS VARCHAR) || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0')"
INVOICE_ID = "'IN-' || CAST(1000 + k // 100000 AS VARCHAR) || '-' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0')"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def m(expression: str) -> str:
    return MONEY.format(f"({expression})")


def choose(by: Column, *values: Column) -> Column:
    """The value numbered ``by``; the last for all other numbers."""
    out = F.when(by == 0, values[0])
    for n, value in enumerate(values[1:-1], 1):
        out = out.when(by == n, value)
    return out.otherwise(values[-1])


# --- scalar functions ---------------------------------------------------------------------------


@query(f"WITH {ORDERS} SELECT k, {m('c')} AS amount FROM o")
def norm_amount_us(spark, sf_dir):
    o = inputs.orders(spark, sf_dir)
    return o.select("k", numbers.amount(inputs.grouped(F.col("c"), ",", ".")).alias("amount"))


@query(f"WITH {ORDERS} SELECT k, {m('c')} AS amount FROM o")
def norm_amount_eu(spark, sf_dir):
    o = inputs.orders(spark, sf_dir)
    return o.select("k", numbers.amount(F.concat(F.lit("kr. "), inputs.grouped(F.col("c"), ".", ","))).alias("amount"))


@query(f"""WITH {ORDERS} SELECT k, CASE k % 6 WHEN 0 THEN {m('c')} WHEN 1 THEN '-' || {m('c')} WHEN 2 THEN '-' || {m('c')}
    WHEN 3 THEN CAST(c // 100 AS VARCHAR) || '.00' WHEN 4 THEN {m('c // 10 * 10')} END AS amount FROM o""")
def norm_amount_mixed(spark, sf_dir):
    o, c = inputs.orders(spark, sf_dir), F.col("c")
    whole = F.floor(c / 100)
    raw = choose(
        F.col("k") % 6,
        F.concat(F.lit(" usd "), F.replace(inputs.grouped(c, "'", "."), F.lit("'"), F.lit(" ")), F.lit(" net")),
        F.concat(F.lit("("), inputs.grouped(c, ",", "."), F.lit(")")),
        F.concat(F.lit("-"), inputs.grouped(c, ".", ","), F.lit("€")),
        F.concat(F.lit("VAT "), F.format_number(whole, 0)),
        F.concat(F.lit("DKK "), whole.cast("string"), F.lit(","), F.floor(c / 10 % 10).cast("string")),
        F.lit("no number"),
    )
    return o.select("k", numbers.amount(raw).alias("amount"))


@query("""SELECT * FROM (VALUES ('100,00 kr.', '10000.00'), ('12.450,00 kr.', NULL), ('kr. 100,00', '100.00'), ('1.234', '1234.00'), ('1,234,567', '1234567.00'),
    ('1.234.56', '1234.56'), ('4,200', '4200.00'), ('(1,234.56)', '-1234.56'), ('-85', '-85.00'), ('8.750,00', '8750.00'), ('  ', NULL), ('1' || chr(160) || '234,56', NULL), ('0,005', '5.00')) t(raw, amount)""")
def norm_amount_quirks(spark, sf_dir):
    raws = ["100,00 kr.", "12.450,00 kr.", "kr. 100,00", "1.234", "1,234,567", "1.234.56", "4,200", "(1,234.56)", "-85", "8.750,00", "  ", "1 234,56", "0,005"]
    return spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", numbers.amount(F.col("raw")).alias("amount"))


@query(f"WITH {ORDERS} SELECT k, CASE WHEN k % 8 < 6 THEN strftime(day, '%Y-%m-%d') END AS iso FROM o")
def norm_date_formats(spark, sf_dir):
    o = inputs.orders(spark, sf_dir)
    shown = [F.date_format("day", p) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "d-M-yyyy", "dd.MM.yyyy", "dd MM yyyy", "MM-yyyy")] + [F.lit("2026-02-30")]
    return o.select("k", numbers.iso_date(F.concat(F.lit(" "), choose(F.col("k") % 8, *shown))).alias("iso"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'DKK' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'DKK' WHEN 4 THEN 'EUR' WHEN 5 THEN 'USD' WHEN 6 THEN 'DKK' END AS code FROM orders""")
def norm_currency(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    raw = choose(F.col("o_orderkey") % 8, *map(F.lit, ("dkk", "Gesamt €", "us$", "12 kr.", "total eur", "$5", " ", "GBP")))
    return o.select(F.col("o_orderkey").alias("k"), numbers.currency(raw, "DKK").alias("code"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5' END AS quantity,
    CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '.00' AS percentage, CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '.00%' AS discount FROM lineitem""")
def norm_quantity(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "lineitem")
    whole = F.col("l_quantity").cast("long").cast("string")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(whole, F.lit(".00"))).otherwise(F.concat(whole, F.lit(",50 ")))
    share = F.concat(F.lit("VAT "), F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%"))
    return rows.select("l_orderkey", "l_linenumber", numbers.quantity(raw).alias("quantity"), numbers.percentage(share).alias("percentage"), numbers.discount(share).alias("discount"))


@query("""SELECT c_custkey, 'INV-' || c_custkey AS id, 'KOBENHAVN ' || trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) || ' MUENCHEN SS A S E' AS party,
    replace(lower(c_name), '#', ' ') || ' & co. a/s' AS name FROM customer""")
def norm_names(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        text.identifier(F.concat(F.lit(" inv–"), F.col("c_custkey").cast("string"), F.lit(" !"))).alias("id"),
        text.match_text(F.concat(F.lit("København "), F.col("c_name"), F.lit(", München ß A/S é"))).alias("party"),
        text.name(F.concat(F.col("c_name"), F.lit("  & Co. \tA/S"))).alias("name"),
    )


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 7 AS INTEGER) AS n FROM part)
    SELECT p_partkey, CASE n WHEN 0 THEN 100.0 WHEN 1 THEN 0.0 WHEN 2 THEN 80.0 WHEN 3 THEN 64.7059 WHEN 4 THEN 72.7273 WHEN 5 THEN 83.871 ELSE 94.1176 END::DOUBLE AS ratio FROM p""")
def supplier_similarity(spark, sf_dir):
    pairs = (("BERLINER MASCHINENBAU GMBH", "BERLINER MASCHINENBAU"), ("AB", "XYZ"), ("KOBENHAVN LOGISTIK APS", "KBH LOGISTIK"), ("SKANDINAVISK EL VVS", "SKAN EL VVS A S"), ("BERLINER MASCHINENBAU GMBH", "BERLINER MASCH"), ("GLOBAL OFFICE SUPPLIES LTD", "GLOBAL OFFICE SUPP"), ("HAMBURG VERPACKUNG", "HAMBURG VERPACKG"))
    p = inputs.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("n"))
    left, right = choose(F.col("n"), *[F.lit(a) for a, _ in pairs]), choose(F.col("n"), *[F.lit(b) for _, b in pairs])
    return p.select("p_partkey", F.round(similarity(left, right), 4).alias("ratio"))


# --- candidates and grounding -------------------------------------------------------------------


def _found(spark, sf_dir, family: str, value: Callable[[Column], Column]) -> DataFrame:
    rows = candidates.extract_candidates(inputs.texts(spark, sf_dir))
    return rows.select("k", F.posexplode(F.transform(F.col("candidates")[family], lambda c: F.struct(value(c).alias("value"), c["raw_value"].alias("raw")))).alias("pos", "c")).select("k", F.col("pos").cast("int").alias("pos"), "c.value")


@query(f"WITH {ORDERS} SELECT k, 0 AS pos, {INVOICE_ID} AS value FROM o")
def cand_ids(spark, sf_dir):
    return _found(spark, sf_dir, "id_candidates", lambda c: c["normalized_value"])


@query(f"WITH {ORDERS} SELECT k, 0 AS pos, strftime(day, '%Y-%m-%d') AS value FROM o")
def cand_dates(spark, sf_dir):
    return _found(spark, sf_dir, "dates", lambda c: c["normalized_value"].cast("string"))


@query("SELECT o_orderkey AS k, 0 AS pos, 'DKK' AS value FROM orders")
def cand_currencies(spark, sf_dir):
    return _found(spark, sf_dir, "currencies", lambda c: c["normalized_value"])


@query("SELECT o_orderkey AS k, 0 AS pos, '25.00' AS value FROM orders")
def cand_percentages(spark, sf_dir):
    return _found(spark, sf_dir, "tax_percentages", lambda c: c["normalized_value"].cast("string"))


@query(f"""WITH {ORDERS}, a AS (
    SELECT k, 0 AS spot, strftime(day, '%d.%m') AS value FROM o
    UNION ALL SELECT k, 1, {m('c * 4 // 5')} FROM o
    UNION ALL SELECT k, 2, {m('c')} FROM o WHERE k % 23 <> 0)
    SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY spot) - 1 AS INTEGER) AS pos, value
    FROM (SELECT k, CAST(CAST(value AS DECIMAL(38,2)) AS VARCHAR) AS value, min(spot) AS spot FROM a GROUP BY ALL)""")
def cand_amounts(spark, sf_dir):
    return _found(spark, sf_dir, "amounts", lambda c: c["normalized_value"].cast("string"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN 'none' ELSE 'embedded_text' END AS text_source, CAST(length(t) AS INTEGER) AS character_count, length(t) >= 40 AS is_text_native, length(t) < 40 AS looks_scanned,
    CASE WHEN t = '' THEN 'no_embedded_text_found' WHEN length(t) < 40 THEN 'embedded_text_is_too_sparse' WHEN length(t) < 120 THEN 'embedded_text_may_be_incomplete' ELSE '' END AS warnings FROM t""")
def text_quality(spark, sf_dir):
    null = F.lit(None)
    d = inputs.table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("document_name"), F.lit(1).alias("pages"), F.col("text").alias("embedded_text"), null.cast("string").alias("ocr_text"), null.cast("array<string>").alias("ocr_warnings"))
    return quality.classify(d).select(F.regexp_extract("document_name", r"^(-?\d+)", 1).cast("long").alias("doc_id"), "text_source", "character_count", "is_text_native", "looks_scanned", F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT CAST(count(*) AS BIGINT) AS rows_, CAST(sum(CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN 1 ELSE 0 END) AS BIGINT) AS warned FROM documents""")
def cand_empty_text(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_name"), "text")
    return candidates.extract_candidates(d).agg(F.count("*").alias("rows_"), F.count_if(F.array_contains("candidates.warnings", candidates.NO_TEXT)).alias("warned"))


def _grounded(spark, sf_dir) -> DataFrame:
    found = candidates.extract_candidates(inputs.texts(spark, sf_dir)).select("k", "candidates")
    return grounding.ground(inputs.extraction(spark, sf_dir).join(found, "k"))


GROUNDED = f"""WITH {ORDERS}, f AS (
    SELECT k, 'invoice_id' AS field_path, CASE WHEN k % 37 = 0 THEN 'unchecked' ELSE 'valid' END AS verdict, CASE WHEN k % 37 = 0 THEN 'field_unknown' ELSE 'normalized_value_found_in_candidates' END AS reason FROM o
    UNION ALL SELECT k, 'po_reference', 'unchecked', 'field_unknown' FROM o
    UNION ALL SELECT k, 'currency', CASE WHEN k % 31 = 0 THEN 'invalid' ELSE 'valid' END, CASE WHEN k % 31 = 0 THEN 'value_failed_normalization' ELSE 'normalized_value_found_in_candidates' END FROM o
    UNION ALL SELECT k, 'invoice_date', 'valid', 'normalized_value_found_in_candidates' FROM o
    UNION ALL SELECT k, 'due_date', 'unchecked', 'field_unknown' FROM o
    UNION ALL SELECT k, 'totals.pre_tax_amount', 'valid', 'normalized_value_found_in_candidates' FROM o
    UNION ALL SELECT k, 'totals.tax_percentage', 'valid', 'normalized_value_found_in_candidates' FROM o
    UNION ALL SELECT k, 'totals.discount', 'unchecked', 'field_unknown' FROM o
    UNION ALL SELECT k, 'supplier_name', 'unchecked', 'no_candidate_family' FROM o
    UNION ALL SELECT k, 'line_items[0].name', 'unchecked', 'no_candidate_family' FROM o
    UNION ALL SELECT k, 'line_items[0].quantity', 'unchecked', 'no_candidate_family' FROM o
    UNION ALL SELECT k, 'line_items[0].amount', 'valid', 'normalized_value_found_in_candidates' FROM o
    UNION ALL SELECT k, 'line_items[0].currency', 'invalid', 'normalized_value_not_found_in_candidates' FROM o
    UNION ALL SELECT k, field_path, CASE WHEN value IS NULL THEN 'unchecked' WHEN hit THEN 'valid' ELSE 'invalid' END, CASE WHEN value IS NULL THEN 'field_unknown' WHEN hit THEN 'normalized_value_found_in_candidates' ELSE 'normalized_value_not_found_in_candidates' END
    FROM (SELECT *, value IN (c * 4 // 5, CASE WHEN k % 23 <> 0 THEN c END, dayv) IS TRUE AS hit FROM (
        SELECT k, c, CAST(strftime(day, '%d%m') AS BIGINT) AS dayv, 'totals.tax_amount' AS field_path, c - c * 4 // 5 + CASE WHEN k % 43 = 0 THEN 100 ELSE 0 END AS value FROM o
        UNION ALL SELECT k, c, CAST(strftime(day, '%d%m') AS BIGINT), 'totals.total_amount', CASE WHEN k % 41 <> 0 THEN c END FROM o)))"""


@query(f"{GROUNDED} SELECT k, field_path, verdict, reason FROM f")
def ground_fields(spark, sf_dir):
    rows = _grounded(spark, sf_dir)
    parts = [rows.select("k", F.explode(f"{kind}_fields").alias("f")).select("k", F.col("f.field_path").alias("field_path"), F.lit(kind).alias("verdict"), F.col("f.reason").alias("reason")) for kind in ("valid", "invalid", "unchecked")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""{GROUNDED} SELECT k, CAST(count(*) FILTER (verdict = 'valid') AS INTEGER) AS valid_fields, CAST(count(*) FILTER (verdict = 'invalid') AS INTEGER) AS invalid_fields, CAST(count(*) FILTER (verdict = 'unchecked') AS INTEGER) AS unchecked_fields FROM f GROUP BY k""")
def ground_counts(spark, sf_dir):
    return _grounded(spark, sf_dir).select("k", *[F.size(c).alias(c) for c in ("valid_fields", "invalid_fields", "unchecked_fields")])


# --- bank, matching, routing --------------------------------------------------------------------

BANK = f"""bank AS (SELECT k AS pos, 'T' || k AS txn_id, CASE WHEN k % 5 = 1 THEN c * 98 // 100 ELSE c END AS paid, party, k % 5 = 2 AS unnamed FROM o WHERE k % 11 <> 0 AND k % 19 <> 0)"""
INVOICE = f"""inv AS (SELECT k, c, party, k % 37 <> 0 AS has_id, k % 41 <> 0 AS has_total, k % 31 <> 0 AS has_currency FROM o WHERE k % 47 <> 0 AND k % 53 <> 0)"""
PAIRS = f"""pair AS (
    SELECT DISTINCT k, pos FROM (
        SELECT inv.k, bank.pos FROM inv JOIN bank ON inv.k = bank.pos AND NOT bank.unnamed WHERE inv.has_id
        UNION ALL SELECT inv.k, bank.pos FROM inv JOIN bank ON abs(inv.c - bank.paid) <= 100
        UNION ALL SELECT inv.k, bank.pos FROM inv JOIN bank ON inv.party = bank.party)),
    scored AS (
        SELECT k, pos, txn_id, ref, exact, alike, CASE WHEN (ref AND exact) OR (NOT ref AND exact AND alike) THEN 'clean' WHEN (ref AND NOT exact) OR (NOT ref AND NOT exact AND alike) THEN 'questionable' ELSE 'none' END AS status,
            (CASE WHEN ref THEN 5000 ELSE 0 END + CASE WHEN exact THEN 3500 ELSE 1750 END + CASE WHEN alike THEN 1500 ELSE 0 END) AS points
        FROM (SELECT p.k, p.pos, b.txn_id, i.has_id AND p.k = p.pos AND NOT b.unnamed AS ref, abs(i.c - b.paid) <= 100 AS exact, i.party = b.party AS alike FROM pair p JOIN inv i ON i.k = p.k JOIN bank b ON b.pos = p.pos WHERE i.has_total)),
    top AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY points DESC, pos) AS rank FROM scored WHERE status <> 'none' QUALIFY rank <= 3)"""
TRIAGE = f"WITH {ORDERS}, {BANK}, {INVOICE}, {PAIRS}"
DECIDED = f"""{TRIAGE}, d AS (
    SELECT i.k, i.c, i.has_id, i.has_total, i.has_currency, t1.status AS status, t1.points AS p1, t2.points AS p2,
        NOT i.has_id OR NOT i.has_total OR NOT i.has_currency AS missing, i.k % 59 = 0 AS bad, i.k % 17 = 0 AS open, i.k % 43 = 0 AND i.has_total AS off, i.k % 29 = 0 AS medium
    FROM inv i LEFT JOIN top t1 ON t1.k = i.k AND t1.rank = 1 LEFT JOIN top t2 ON t2.k = i.k AND t2.rank = 2),
    routed AS (
        SELECT k, CASE WHEN missing OR bad OR off THEN 'reject' WHEN status IS NULL OR medium OR open OR status <> 'clean' THEN 'review' ELSE 'auto_accept' END AS outcome,
            CASE WHEN missing OR bad OR off THEN 'low' WHEN medium OR open THEN 'medium' ELSE 'high' END AS extraction_confidence, coalesce(status, 'none') AS match_status FROM d
        UNION ALL SELECT k, 'reject', 'low', 'none' FROM o WHERE k % 47 = 0 OR k % 53 = 0)"""


@query(f"""WITH {ORDERS} SELECT 'T' || k AS txn_id, CAST((CASE WHEN k % 5 = 1 THEN c * 98 // 100 ELSE c END) AS BIGINT) AS cents, '-' || {m('CASE WHEN k % 5 = 1 THEN c * 98 // 100 ELSE c END')} AS raw_amount FROM o WHERE k % 11 <> 0 AND k % 19 <> 0""")
def bank_scan(spark, sf_dir):
    return files.bank_rows(inputs.payments(spark, sf_dir)).select("txn_id", (F.col("amount") * 100).cast("long").alias("cents"), "raw_amount")


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    records = inputs.records(spark, sf_dir).where("record_type = 'validated_extraction'")
    return matching.invoices_of(records), files.bank_rows(inputs.payments(spark, sf_dir))


@query(f"WITH {ORDERS}, {BANK}, {INVOICE} SELECT inv.k AS rec_id, bank.pos AS bank_pos FROM inv JOIN bank ON inv.k = bank.pos AND NOT bank.unnamed WHERE has_id AND has_total")
def match_reference(spark, sf_dir):
    invoices, bank = _sides(spark, sf_dir)
    return matching.by_reference(matching.keyed_invoices(invoices).where("total_amount > 0"), matching.keyed_bank(bank))


@query(f"WITH {ORDERS}, {BANK}, {INVOICE} SELECT inv.k AS rec_id, bank.pos AS bank_pos FROM inv JOIN bank ON abs(inv.c - bank.paid) <= 100 WHERE has_total")
def match_amount(spark, sf_dir):
    invoices, bank = _sides(spark, sf_dir)
    return matching.by_amount(invoices.where("total_amount > 0"), bank)


def _decided(spark, sf_dir) -> DataFrame:
    return routing.triage(inputs.records(spark, sf_dir), files.bank_rows(inputs.payments(spark, sf_dir)))


@query(f"{DECIDED} SELECT k, outcome, extraction_confidence, match_status FROM routed")
def triage_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select(F.col("rec_id").alias("k"), "outcome", "extraction_confidence", "match_status")


@query(f"""{DECIDED}, x AS (SELECT d.*, t1.ref, t1.exact, t1.alike, t2.points IS NOT NULL AND t2.points >= t1.points - 500 AS several,
        [CASE WHEN NOT has_id THEN 'missing_invoice_id' END, CASE WHEN NOT has_currency THEN 'missing_currency' END, CASE WHEN NOT has_total THEN 'missing_total_amount' END,
         CASE WHEN bad THEN 'critical_field_failed_validation:currency' END, CASE WHEN open AND NOT missing AND NOT bad THEN 'critical_candidate_validation_missing:totals.total_amount' END, CASE WHEN off THEN 'total_integrity_failed' END] AS doubt,
        CASE WHEN t1.status = 'clean' THEN [] ELSE [CASE WHEN NOT t1.ref THEN 'invoice_id_missing_from_bank_reference' END, CASE WHEN NOT t1.exact THEN 'amount_mismatch_requires_review' END] END AS top_reasons
        FROM d LEFT JOIN top t1 ON t1.k = d.k AND t1.rank = 1 LEFT JOIN top t2 ON t2.k = d.k AND t2.rank = 2)
    SELECT k, CASE WHEN has_total THEN {m('c')} END AS invoice_amount, array_to_string(list_filter(CASE WHEN missing OR bad OR off THEN doubt WHEN status IS NULL THEN list_append(doubt, 'no_plausible_bank_match')
        WHEN medium OR open THEN doubt || top_reasons || [CASE WHEN several THEN 'multiple_candidate_matches' END, 'extraction_confidence_below_auto_accept_threshold']
        WHEN status <> 'clean' THEN doubt || top_reasons || [CASE WHEN several THEN 'multiple_candidate_matches' END, 'match_status_' || status] ELSE doubt END, lambda r: r IS NOT NULL), ';') AS reasons FROM x
    UNION ALL SELECT k, NULL, CASE WHEN k % 47 = 0 THEN 'extraction_failed' ELSE 'unsupported_extraction_record_type:draft' END FROM o WHERE k % 47 = 0 OR k % 53 = 0""")
def triage_reasons(spark, sf_dir):
    return _decided(spark, sf_dir).select(F.col("rec_id").alias("k"), "invoice_amount", F.array_join("reasons", ";").alias("reasons"))


@query(f"""WITH {ORDERS} SELECT k, CASE WHEN k % 4 = 3 OR k % 3 = 0 THEN 'questionable' ELSE 'clean' END AS status, CASE k % 4 WHEN 3 THEN 'medium' ELSE 'high' END AS supplier,
    CASE k % 4 WHEN 2 THEN 0.8636 WHEN 3 THEN 0.6486 ELSE 1.0 END::DOUBLE AS score, CASE k % 4 WHEN 3 THEN 'invoice_id_missing_from_bank_reference,supplier_fuzzy_match_medium:0.65'
    ELSE CASE WHEN k % 3 = 0 THEN 'invoice_id_missing_from_bank_reference,amount_mismatch_requires_review' ELSE '' END END AS reasons FROM o WHERE k % 4 <> 3 OR k % 3 <> 0""")
def triage_names(spark, sf_dir):
    """Invoices without number; every order has names of its own, equal, turned round, cut short, or half another."""
    o, k = inputs.orders(spark, sf_dir).select("k"), F.col("k")
    digest = F.md5(k.cast("string").cast("binary"))
    one, two = F.substring(digest, 1, 12), F.substring(digest, 13, 12)
    party = choose(k % 4, F.concat_ws(" ", one, two), F.concat_ws(" ", two, one), F.concat_ws(" ", one, F.substring(two, 1, 6)), F.concat_ws(" ", one, F.repeat(F.lit("z"), 12)))
    money = lambda c: c.cast("decimal(38,2)")
    invoices = o.select(k.alias("rec_id"), F.lit(None).cast("string").alias("invoice_id"), F.concat_ws(" ", one, two).alias("supplier_name"), money(k * 10 + 10).alias("total_amount"))
    bank = o.select(k.alias("bank_pos"), F.concat(F.lit("T"), k.cast("string")).alias("txn_id"), F.lit("").alias("date"), party.alias("counterparty"), F.lit("").alias("reference"), F.lit("").alias("category"), F.lit("").alias("raw_amount"), money(k * 10 + 10 + F.when(k % 3 == 0, 5).otherwise(0)).alias("amount"))
    best = matching.best_matches(invoices, bank)
    t = F.get("matched_transactions", F.lit(0))
    s = t["signal_checks"]["supplier"]
    return best.select(F.col("rec_id").alias("k"), t["match_status"].alias("status"), s["status"].alias("supplier"), s["score"].alias("score"), F.array_join(t["reasons"], ",").alias("reasons"))


@query(f"{TRIAGE} SELECT k, CAST(rank AS INTEGER) AS rank, txn_id, status FROM top")
def triage_topk(spark, sf_dir):
    best = matching.best_matches(*_sides(spark, sf_dir))
    return best.select(F.col("rec_id").alias("k"), F.posexplode("matched_transactions").alias("at", "t")).select("k", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.txn_id").alias("txn_id"), F.col("t.match_status").alias("status"))


@query(f"{DECIDED} SELECT k AS k, p2 IS NOT NULL AND p2 >= p1 - 500 AS multiple FROM d WHERE status IS NOT NULL")
def triage_multi_match(spark, sf_dir):
    return matching.best_matches(*_sides(spark, sf_dir)).select(F.col("rec_id").alias("k"), "multiple")


@query(f"""{DECIDED} SELECT count(*) AS records, count(*) FILTER (outcome = 'auto_accept') AS auto_accept, count(*) FILTER (outcome = 'review') AS review, count(*) FILTER (outcome = 'reject') AS reject FROM routed""")
def triage_outcome_counts(spark, sf_dir):
    return summaries.outcome_counts(triage_decisions(spark, sf_dir))


@query(f"""{DECIDED} SELECT k, array_to_string(list_filter([
        CASE WHEN NOT has_id THEN 'missing_invoice_id' END, CASE WHEN NOT has_currency THEN 'missing_currency' END, CASE WHEN NOT has_total THEN 'missing_total_amount' END,
        CASE WHEN bad THEN 'critical_field_failed_validation:currency' END,
        CASE WHEN NOT missing AND NOT bad THEN CASE WHEN open THEN 'critical_candidate_validation_missing:totals.total_amount' ELSE 'critical_candidate_validation_passed' END END,
        CASE WHEN off THEN 'total_integrity_failed' ELSE 'total_integrity_check_passed' END], lambda x: x IS NOT NULL), ';') AS reasons FROM d""")
def extraction_reasons(spark, sf_dir):
    invoices, _ = _sides(spark, sf_dir)
    return routing.with_reasons(invoices).select(F.col("rec_id").alias("k"), F.array_join("extraction_reasons", ";").alias("reasons"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS net, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 1 THEN true ELSE false END AS failed FROM c""")
def total_integrity(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", inputs.cents(F.col("l_extendedprice")).alias("net"), inputs.cents(F.col("l_tax")).alias("tax"))
    money = lambda x: (x.cast("decimal(20,0)") / 100).cast("decimal(38,2)")
    line = F.col("l_linenumber") % 4
    total = F.col("net") + F.col("tax") + F.when(line == 1, 3).when(line == 2, 2).otherwise(0)
    return c.select("l_orderkey", "l_linenumber", routing.total_integrity_failed(money(F.col("net")), money(F.when(line != 3, F.col("tax"))), F.lit(None).cast("decimal(38,2)"), money(total)).alias("failed"))


# --- evaluation ---------------------------------------------------------------------------------

EVAL = f"""WITH {ORDERS}, base AS (SELECT *, k % 47 <> 0 AND k % 53 <> 0 AS good FROM o), f AS (
    SELECT k, 'invoice_id' AS field_path, CASE WHEN good AND k % 37 <> 0 THEN 'correct' ELSE 'miss' END AS outcome FROM base
    UNION ALL SELECT k, 'supplier_name', CASE WHEN good THEN 'correct' ELSE 'miss' END FROM base
    UNION ALL SELECT k, 'currency', CASE WHEN NOT good THEN 'miss' WHEN k % 31 = 0 THEN 'hallucination' ELSE 'correct' END FROM base WHERE k % 13 <> 0
    UNION ALL SELECT k, 'invoice_date', CASE WHEN good THEN 'correct' ELSE 'miss' END FROM base
    UNION ALL SELECT k, 'due_date', CASE WHEN k % 3 = 0 THEN 'correct_absent' ELSE 'miss' END FROM base
    UNION ALL SELECT k, 'po_reference', 'correct_absent' FROM base
    UNION ALL SELECT k, 'totals.pre_tax_amount', CASE WHEN good THEN 'correct' ELSE 'miss' END FROM base
    UNION ALL SELECT k, 'totals.tax_percentage', CASE WHEN good THEN 'correct' ELSE 'miss' END FROM base
    UNION ALL SELECT k, 'totals.tax_amount', CASE WHEN NOT good THEN 'miss' WHEN k % 43 = 0 THEN 'hallucination' ELSE 'correct' END FROM base
    UNION ALL SELECT k, 'totals.discount', 'correct' FROM base
    UNION ALL SELECT k, 'totals.total_amount', CASE WHEN good AND k % 41 <> 0 THEN 'correct' ELSE 'miss' END FROM base
    UNION ALL SELECT k, 'line_items[0].name', CASE WHEN good THEN 'correct' ELSE 'miss' END FROM base
    UNION ALL SELECT k, 'line_items[0].quantity', CASE WHEN good THEN 'correct' ELSE 'miss' END FROM base
    UNION ALL SELECT k, 'line_items[0].amount', CASE WHEN good THEN 'correct' ELSE 'miss' END FROM base
    UNION ALL SELECT k, 'line_items[0].currency', CASE WHEN good THEN 'hallucination' ELSE 'correct_absent' END FROM base)"""
METRICS = """count(*) AS total, count(*) FILTER (outcome IN ('correct', 'correct_absent')) AS correct, count(*) FILTER (outcome = 'correct_absent') AS correct_absent, count(*) FILTER (outcome = 'hallucination') AS hallucinations,
    count(*) FILTER (outcome = 'hallucination') AS confident_hallucinations, count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome = 'label_error') AS label_errors, count(*) FILTER (outcome IN ('correct', 'correct_absent')) / count(*) AS accuracy"""


def _evaluated(spark, sf_dir) -> DataFrame:
    """Field results of all records; drafts, which an evaluation refuses, come in as the failures that the SQL counts them as."""
    records = inputs.records(spark, sf_dir)
    kind = F.when(F.col("record_type") == "draft", F.lit("error")).otherwise(F.col("record_type"))
    return evaluation.field_results(inputs.golden(spark, sf_dir), records.withColumn("record_type", kind))


@query(f"{EVAL} SELECT 'doc-' || k || '.pdf' AS document_name, field_path, outcome FROM f")
def eval_fields(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("document_name", "field_path", "outcome")


@query(f"{EVAL} SELECT {METRICS} FROM f")
def eval_summary(spark, sf_dir):
    return evaluation.summary(_evaluated(spark, sf_dir))


@query(f"{EVAL} SELECT regexp_replace(field_path, '\\[\\d+\\]', '[]') AS metric_key, {METRICS} FROM f GROUP BY 1")
def eval_by_metric(spark, sf_dir):
    return evaluation.by_metric(_evaluated(spark, sf_dir))


@query(f"{EVAL} SELECT 'doc-' || k || '.pdf' AS document_name, field_path, outcome FROM f WHERE outcome IN ('hallucination', 'miss', 'label_error')")
def eval_failures(spark, sf_dir):
    return evaluation.failures(_evaluated(spark, sf_dir)).select("document_name", "field_path", "outcome")


@query(f"""WITH {ORDERS} SELECT 'doc-' || k || '.pdf' AS document_name, CASE WHEN k % 47 = 0 OR k % 53 = 0 THEN 'error' ELSE 'validated_extraction' END AS pipeline_record_type,
    CASE WHEN k % 13 = 0 THEN 'missing_expected_field:currency' ELSE '' END AS label_warnings FROM o""")
def golden_left_join(spark, sf_dir):
    found = evaluation.document_results(inputs.golden(spark, sf_dir), inputs.records(spark, sf_dir))
    return found.select("document_name", "pipeline_record_type", F.array_join("label_warnings", ",").alias("label_warnings"))


def _lines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Golden items of every order in line order, and predicted items reversed, some with one more."""
    rows = inputs.table(spark, sf_dir, "lineitem")
    q = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    price = inputs.plain(inputs.cents(F.col("l_extendedprice")))
    label = F.concat(F.lit("item "), F.col("l_linenumber").cast("string"), F.lit("x"), F.col("l_partkey").cast("string"))
    as_json = F.concat(F.lit('{"name":'), q(label), F.lit(',"quantity":'), F.col("l_quantity").cast("long").cast("string"), F.lit(',"amount":'), q(price), F.lit("}"))
    none = F.lit(None).cast("string")
    item = F.struct(inputs.field(label).alias("name"), inputs.field(F.col("l_quantity").cast("long").cast("string")).alias("quantity"), inputs.field(price).alias("amount"), inputs.field(none).alias("currency"))
    grouped = rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), as_json.alias("j"), item.alias("i")))).alias("all"))
    extra = F.struct(inputs.field(F.lit("zzzz")).alias("name"), *[inputs.field(none).alias(p) for p in ("quantity", "amount", "currency")])
    predicted = F.reverse(F.transform("all", lambda x: x["i"]))
    predicted = F.when(F.col("k") % 7 == 0, F.concat(predicted, F.array(extra))).otherwise(predicted)
    name = F.concat(F.lit("doc-"), F.col("k").cast("string")).alias("document_name")
    golden = grouped.select(name, F.concat(F.lit('{"line_items":['), F.array_join(F.transform("all", lambda x: x["j"]), ","), F.lit("]}")).alias("expected"))
    blank = inputs.field(none)
    e = F.struct(name, F.lit("s").alias("extraction_method"), *[blank.alias(p) for p in ("invoice_id", "supplier_name", "currency", "invoice_date", "due_date", "po_reference")], F.struct(*[blank.alias(p) for p in ("pre_tax_amount", "tax_percentage", "tax_amount", "discount", "total_amount")]).alias("totals"), predicted.alias("line_items"), F.array().cast("array<string>").alias("warnings"))
    return golden, grouped.select(F.lit("validated_extraction").alias("record_type"), name, e.alias("extraction"))


@query("SELECT l_orderkey AS k, CAST(3 * count(*) AS BIGINT) AS fields, CAST(3 * count(*) AS BIGINT) AS correct FROM lineitem GROUP BY 1")
def eval_line_items(spark, sf_dir):
    results = evaluation.field_results(*_lines(spark, sf_dir)).where("metric_key <> 'line_items.extra'")
    return results.groupBy(F.substring("document_name", 5, 30).cast("long").alias("k")).agg(F.count("*").alias("fields"), F.count_if("correct").alias("correct"))


@query("SELECT 'doc-' || l_orderkey AS document_name, 'line_items.extra[' || count(*) || ']' AS field_path, 'name=zzzz' AS predicted FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY l_orderkey")
def eval_extra_items(spark, sf_dir):
    results = evaluation.field_results(*_lines(spark, sf_dir)).where("metric_key = 'line_items.extra'")
    return results.select("document_name", "field_path", "predicted")


# --- traces and records -------------------------------------------------------------------------


@query(f"""WITH {ORDERS} SELECT k, CAST(CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 41 = 0 THEN 1 ELSE 0 END + 3 AS INTEGER) AS unknown, CAST(CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS INTEGER) AS medium, 1 AS items FROM o""")
def trace_histogram(spark, sf_dir):
    rows = inputs.extraction(spark, sf_dir).select("k", summaries.field_histograms(F.col("extraction")).alias("h"))
    count = lambda name, key: F.coalesce(F.try_element_at(F.col(f"h.{name}"), F.lit(key)), F.lit(0))
    return rows.select("k", count("field_status_counts", "unknown").alias("unknown"), count("confidence_counts", "medium").alias("medium"), F.col("h.line_item_count").alias("items"))


@query("SELECT event_id, CAST(event_id % 100 AS BIGINT) AS input_tokens, CAST(2 AS INTEGER) AS kept FROM events")
def token_usage(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    usage = F.create_map(F.lit("input_tokens"), F.col("event_id") % 100, F.lit("output_tokens"), F.lit(5).cast("long"), F.lit("cost"), F.lit(1).cast("long"), F.lit("cached_tokens"), F.lit(None).cast("long"))
    kept = summaries.token_usage(usage)
    return e.select("event_id", F.try_element_at(kept, F.lit("input_tokens")).alias("input_tokens"), F.size(kept).alias("kept"))


@query(f"""WITH {ORDERS} SELECT CASE WHEN k % 47 = 0 THEN 'error' WHEN k % 53 = 0 THEN 'draft' ELSE 'validated_extraction' END AS record_type, count(*) AS n FROM o GROUP BY 1""")
def jsonl_union(spark, sf_dir):
    records = inputs.records(spark, sf_dir)
    parts = [records.where(F.col("record_type") == kind) for kind in ("error", "draft", "validated_extraction")]
    slim = [p.select("record_type", "document_name", *extra) for p, extra in zip(parts, (["reason"], [], ["extraction"]), strict=True)]
    joined = slim[0].unionByName(slim[1], allowMissingColumns=True).unionByName(slim[2], allowMissingColumns=True)
    return joined.groupBy("record_type").agg(F.count("*").alias("n"))


@query(f"""{TRIAGE} SELECT k, CAST(rank AS INTEGER) AS rank, CASE WHEN ref THEN 'exact' ELSE 'missing' END AS reference, CASE WHEN exact THEN 'exact' ELSE 'questionable' END AS amount,
    CASE WHEN alike THEN 'high' ELSE 'low' END AS supplier, CASE WHEN alike THEN 1.0 ELSE 0.0 END::DOUBLE AS supplier_score,
    CASE WHEN status = 'clean' THEN '' ELSE concat_ws(',', CASE WHEN NOT ref THEN 'invoice_id_missing_from_bank_reference' END, CASE WHEN NOT exact THEN 'amount_mismatch_requires_review' END) END AS reasons FROM top""")
def triage_signals(spark, sf_dir):
    best = matching.best_matches(*_sides(spark, sf_dir))
    rows = best.select(F.col("rec_id").alias("k"), F.posexplode("matched_transactions").alias("at", "t"))
    s = F.col("t.signal_checks")
    return rows.select("k", (F.col("at") + 1).cast("int").alias("rank"), s["reference"]["status"].alias("reference"), s["amount"]["status"].alias("amount"), s["supplier"]["status"].alias("supplier"), s["supplier"]["score"].alias("supplier_score"), F.array_join("t.reasons", ",").alias("reasons"))


@query("""WITH t AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS n FROM documents)
    SELECT count(*) AS records, count(*) FILTER (doc_id % 10 <> 0) AS text_reports, count(*) FILTER (doc_id % 10 <> 0 AND n < 40) AS scanned, CAST(0 AS BIGINT) AS ocr, count(*) FILTER (doc_id % 10 = 0) AS errors FROM t""")
def report_text_counts(spark, sf_dir):
    null = F.lit(None)
    d = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_name"), F.lit(1).alias("pages"), F.col("text").alias("embedded_text"), null.cast("string").alias("ocr_text"), null.cast("array<string>").alias("ocr_warnings"))
    failed = F.col("document_name").cast("long") % 10 == 0
    return summaries.text_counts(quality.classify(d).withColumn("record_type", F.when(failed, F.lit("error")).otherwise(F.lit("pdf_text"))))


@query("SELECT count(*) AS records, count(*) AS candidate_reports, count(*) FILTER (o_orderkey % 9 = 0) AS empty, CAST(0 AS BIGINT) AS errors FROM orders")
def report_candidate_counts(spark, sf_dir):
    texts = inputs.texts(spark, sf_dir)
    return summaries.candidate_counts(candidates.reports(texts.withColumn("text", F.when(F.col("k") % 9 != 0, F.col("text")))))


@query(f"""WITH {ORDERS}, r AS (SELECT k, k % 47 <> 0 AND k % 53 <> 0 AS good FROM o)
    SELECT count(*) AS records, count(*) FILTER (good) AS validated, count(*) FILTER (good AND k % 59 = 0) AS invalid_fields, count(*) FILTER (k % 47 = 0) AS errors FROM r""")
def report_extraction_counts(spark, sf_dir):
    return summaries.extraction_counts(inputs.records(spark, sf_dir))
