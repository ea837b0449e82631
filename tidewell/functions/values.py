"""Parsers of values in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents

# Metres in a unit, and French month names without marks.
METRES = {"m": 1.0, "cm": 0.01, "mm": 0.001}
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")


def first_decimal(text: Column) -> Column:
    """the first number, with comma or dot, as double; null if there is none."""
    return F.replace(F.nullif(F.regexp_extract(text, "(-?[0-9]+(?:[.,][0-9]+)?)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).try_cast("long")


def to_metres(value: Column, unit: Column) -> Column:
    """metres, rounded half to even at the millimetre; unknown units give null."""
    factor = F.lit(None).cast("double")
    for name, metres in METRES.items():
        factor = F.when(unit == name, F.lit(metres)).otherwise(factor)
    return F.bround(value * factor, 3)


def dimension_metres(text: Column) -> Column:
    """a length with its unit in metres (no unit: metres); products like ``3x4`` are refused."""
    low = F.lower(text)
    unit = F.nullif(F.regexp_extract(low, "[0-9]\\s*(mm|cm|m)(?![a-z0-9²])", 1), F.lit(""))
    return F.when(low.rlike("[0-9]\\s*[x×]\\s*[0-9]"), F.lit(None).cast("double")).otherwise(to_metres(first_decimal(text), F.coalesce(unit, F.lit("m"))))


def grammage(text: Column) -> Column:
    """grams a square metre."""
    return F.replace(F.nullif(F.regexp_extract(F.lower(text), "([0-9]+(?:[.,][0-9]+)?)\\s*(?:g\\s*/\\s*m2|g\\s*/\\s*m²|gr?\\b)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def french_date(text: Column) -> Column:
    """``3 mars 2024`` or ``03/04/2024`` as a date; impossible ones are null."""
    low = strip_accents(text)
    day, name, year = (F.regexp_extract(low, "([0-9]{1,2})(?:er)?\\s+([a-z]+)\\s+([0-9]{4})", k) for k in (1, 2, 3))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    literal = F.try_to_date(F.concat_ws("-", year, month.cast("string"), day), "y-M-d")
    numeric = F.try_to_date(F.concat_ws("-", *[F.regexp_extract(low, "([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})", k) for k in (3, 2, 1)]), "y-M-d")
    return F.when((name != "") & (month > 0), literal).otherwise(numeric)


def french_boolean(text: Column) -> Column:
    """words that begin with oui or non; anything else is null."""
    low = F.trim(strip_accents(text))
    return F.when(low.startswith("oui"), F.lit(True)).when(low.startswith("non"), F.lit(False))


def name_and_detail(text: Column) -> Column:
    """struct of the name before parentheses and the detail inside."""
    return F.struct(
        F.trim(F.regexp_replace(text, "\\s*\\([^)]*\\)", "")).alias("name"),
        F.nullif(F.trim(F.regexp_extract(text, "\\(([^)]*)\\)", 1)), F.lit("")).alias("detail"),
    )


def parts(text: Column) -> Column:
    """pieces between middle dots, semicolons and bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[·;|]"), lambda x: F.trim(x)), lambda x: x != "")


def needs_ocr(text: Column, least: int = 20) -> Column:
    """fewer than ``least`` characters of native text."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least
