"""Numbers, dates and currencies in the notations of several countries, as expressions without UDFs.

Digits beyond ASCII are not read. Numbers of more than 20 integer digits give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import WHITE, is_missing, let, stripped

# Supported currencies, in the order in which text is searched for them, and signs.
CURRENCIES = ("DKK", "EUR", "USD")
SIGNS = (("€", "EUR"), ("$", "USD"), ("US$", "USD"), ("KR", "DKK"), ("KR.", "DKK"))
MONEY_WORDS = r"(?U)\b(?:DKK|EUR|USD|KR\.?|VAT|MOMS)\b"
NUMBER = r"(?U)-?\(?\d[\d\s.,']*\)?"
WIDE = "decimal(38,18)"


def currency(value: Column, default: str | None = None) -> Column:
    """Code of the currency that a text names; blank texts give the default."""
    chosen = F.lit(default if default in CURRENCIES else None).cast("string")

    def named(up: Column) -> Column:
        out = F.when(up.isin(*CURRENCIES), up)
        for sign, currency_code in SIGNS:
            out = out.when(up == sign, F.lit(currency_code))
        out = out.when(F.contains(up, F.lit("€")), F.lit("EUR")).when(F.contains(up, F.lit("$")), F.lit("USD")).when(F.contains(up, F.lit("KR")) & up.rlike(r"(?U)\bKR\.?\b"), F.lit("DKK"))
        for currency_code in CURRENCIES:
            out = out.when(F.contains(up, F.lit(currency_code)) & up.rlike(rf"(?U)\b{currency_code}\b"), F.lit(currency_code))
        return out

    return F.when(is_missing(value), chosen).otherwise(let(stripped(F.upper(value)), named))


def iso_date(value: Column) -> Column:
    """yyyy-MM-dd of a date written year first (- or /) or day first (- . / or spaces); else null."""

    def read(v: Column) -> Column:
        year_first = F.try_to_date(F.replace(v, F.lit("/"), F.lit("-")), "yyyy-M-d")
        day_first = F.try_to_date(F.regexp_replace(v, r"(?U)\s+|[./]", "-"), "d-M-yyyy")
        found = F.when(v.rlike(r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"), year_first).when(v.rlike(r"(?U)^\d{1,2}(?:([./-])\d{1,2}\1|\s+\d{1,2}\s+)\d{4}$"), day_first)
        return F.date_format(found, "yyyy-MM-dd")

    return let(stripped(value), read)


def first_number(value: Column) -> Column:
    """The first number in a text as it stands there, without spaces; null if there is none."""
    words = F.translate(F.regexp_replace(F.upper(value), MONEY_WORDS, " "), "€$", "  ")
    return F.nullif(F.translate(F.regexp_extract(words, NUMBER, 0), " '", ""), F.lit(""))


def bare(number: Column) -> Column:
    """``first_number`` without brackets."""
    return F.btrim(number, F.lit("()"))


#: Numbers whose last separator is decimal: it is the only one, before one or two digits; the last of several of
#: its kind, before two digits; or the only one of its kind, behind the other kind.
DECIMAL = r"(?s)^(?:[^.,]*[.,][^.,]{1,2}|[^.]*,[^.]*,[^.,]{2}|[^,]*\.[^,]*\.[^.,]{2}|[^,]*\.[^,]*,[^.,]*|[^.]*,[^.]*\.[^.,]*)\z"


def decimal_text(number: Column, core: Column) -> Column:
    """A number of ``first_number``, and its ``bare`` form, with sign, digits and a decimal point; null if separators make no sense."""
    parted = F.translate(F.regexp_replace(core, r"(?s)[.,](?=.*[.,])", ""), ",", ".")
    plain = F.when(core.rlike(DECIMAL), parted).when(~core.rlike(r"(?s)\..*,|,.*\."), F.translate(core, ".,", ""))
    signed = F.startswith(number, F.lit("(")) & F.endswith(number, F.lit(")")) & ~F.startswith(core, F.lit("-")) & (F.translate(core, "0.," + WHITE, "") != "")
    return F.when(signed, F.concat(F.lit("-"), stripped(plain))).otherwise(stripped(plain))


def wide(text: Column) -> Column:
    """The decimal of ``decimal_text``."""
    return text.try_cast(WIDE)


def as_money(text: Column) -> Column:
    """``decimal_text`` as decimal(38,2), halves away from zero."""
    return F.round(wide(text), 2).cast("decimal(38,2)")


def as_amount(text: Column) -> Column:
    """``decimal_text`` with two decimals, as text; a negative zero keeps its sign."""
    shown = as_money(text).cast("string")
    return F.when(F.startswith(text, F.lit("-")) & (shown == "0.00"), F.lit("-0.00")).otherwise(shown)


def as_quantity(text: Column) -> Column:
    """``decimal_text`` without trailing zeros."""
    return F.rtrim(F.rtrim(wide(text).cast("string"), F.lit("0")), F.lit("."))


def with_decimal_texts(rows: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``rows`` with the ``decimal_text`` of each text as a column; each step is computed once a row, as a column of its own."""
    held = {name: f"_{name}_found" for name in texts}
    rows = rows.withColumns({held[name]: first_number(text) for name, text in texts.items()})
    rows = rows.withColumns({f"{h}_bare": bare(F.col(h)) for h in held.values()})
    return rows.withColumns({name: decimal_text(F.col(h), F.col(f"{h}_bare")) for name, h in held.items()}).drop(*held.values(), *[f"{h}_bare" for h in held.values()])


def _read(value: Column, body) -> Column:
    """``body`` of the ``decimal_text`` of a text."""
    return let(first_number(value), lambda found: body(decimal_text(found, bare(found))))


def parsed(value: Column) -> Column:
    """The first number in a text, unrounded."""
    return _read(value, wide)


def money(value: Column) -> Column:
    """The first number in a text as decimal(38,2), halves away from zero."""
    return _read(value, as_money)


def amount(value: Column) -> Column:
    """The first number in a text with two decimals, as text; a negative zero keeps its sign."""
    return _read(value, lambda text: let(text, as_amount))


def percentage(value: Column) -> Column:
    """A percentage without its sign, two decimals."""
    return amount(value)


def discount(value: Column) -> Column:
    """A discount; percentages keep their sign."""
    return F.when(F.contains(value, F.lit("%")), F.concat(percentage(value), F.lit("%"))).otherwise(amount(value))


def quantity(value: Column) -> Column:
    """A number without trailing zeros."""
    return _read(value, as_quantity)


def two_places(value: Column) -> Column:
    """A decimal as text with two decimals; null stays null."""
    return value.cast("decimal(38,2)").cast("string")
