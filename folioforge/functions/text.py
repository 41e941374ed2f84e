"""Text expressions: missing values, whitespace, identifiers and names. All are Column -> Column, without UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space of Unicode, as \s of a pattern with (?U) reads it.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def stripped(value: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(value, F.lit(WHITE))


def is_missing(value: Column) -> Column:
    """Null or blank."""
    return F.coalesce(stripped(value) == "", F.lit(True))


def present(value: Column) -> Column:
    """The value, or null if it is blank."""
    return F.when(stripped(value) != "", value)


def collapsed(value: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.btrim(F.regexp_replace(value, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def plain_text(value: Column, upper: bool = False) -> Column:
    """Collapsed text for comparison; null if blank."""
    out = collapsed(present(value))
    return F.upper(out) if upper else out


def name(value: Column) -> Column:
    """A name for fuzzy comparison: lower case, letters, digits, _ & / + . - kept; null if blank."""
    return collapsed(F.regexp_replace(F.lower(plain_text(value)), r"(?U)[^\w\s&/+.-]", " "))


def code(value: Column) -> Column:
    """Stripped and upper case; null if empty."""
    return F.nullif(F.upper(stripped(value)), F.lit(""))


def identifier(value: Column) -> Column:
    """A document number for containment tests: upper case, long dashes as hyphens, A-Z 0-9 and hyphens kept."""
    return F.regexp_replace(F.regexp_replace(F.upper(value), "[—–]", "-"), "[^A-Z0-9-]", "")


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII letter or digit (and marks), and those forms."""
    pairs = []
    for c in map(chr, range(0x80, 0x10000)):
        form = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(form) == 1 and form.isascii() and form.isalnum():
            pairs.append((c, form))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Letters that become other letters before marks are dropped.
SPELLED = (("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE"), ("Æ", "AE"), ("Ø", "O"), ("Å", "A"))


def match_text(value: Column) -> Column:
    """A party's name for similarity: upper case ASCII letters and digits, other runs as one space.

    Compatibility forms of several letters count as gaps.
    """
    out = F.upper(value)
    for letter, spelled in SPELLED:
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    out = F.regexp_replace(F.translate(out, *_folding()), r"\p{M}+", "")
    return F.btrim(F.regexp_replace(out, "[^A-Z0-9]+", " "))
