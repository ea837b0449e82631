"""Scalars of fields, files and layouts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_reference_shape, search_key
from .values import METRES

_NUMBER = "[0-9]+(?:[.,][0-9]+)?"


def _double(text: Column) -> Column:
    return F.replace(F.nullif(text, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def paired_dimensions(text: Column) -> Column:
    """array of (first, second) of every ``number x number`` in free text."""
    found = F.regexp_extract_all(text, F.lit(f"({_NUMBER})\\s*[xX×]\\s*{_NUMBER}"), F.lit(1))
    other = F.regexp_extract_all(text, F.lit(f"{_NUMBER}\\s*[xX×]\\s*({_NUMBER})"), F.lit(1))
    return F.transform(F.arrays_zip(found.alias("a"), other.alias("b")), lambda p: F.struct(_double(p["a"]).alias("first"), _double(p["b"]).alias("second")))


def field_values(text: Column, labels: Sequence[str]) -> Column:
    """array of (label, value, suspect) of the labels found; a value that holds another label has bled into it."""
    entries = []
    for label in labels:
        value = F.nullif(F.trim(F.regexp_extract(text, f"(?i)(?<![a-z]){label}\\s*:\\s*([^;\\n]*)", 1)), F.lit(""))
        others = [F.contains(F.lower(value), F.lit(f"{other.lower()}:")) for other in labels if other != label]
        suspect = F.coalesce(F.array_contains(F.array(*others), True) if others else F.lit(False), F.lit(False))
        entries.append(F.when(value.isNotNull(), F.struct(F.lit(label).alias("label"), value.alias("value"), suspect.alias("suspect"))))
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def field_confidence(values: Column, n_labels: int) -> Column:
    """labels with a value that is not suspect, over all labels."""
    return F.round(F.size(F.filter(values, lambda v: ~v["suspect"])) / n_labels, 4)


def anchor_class(text: Column, strong: Sequence[str], weak: Sequence[str]) -> Column:
    """technical with two anchors of which one is strong, or with three of any; else plan."""
    hit = lambda words: sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    s, w = hit(strong), hit(weak)
    return F.when(((s > 0) & (s + w >= 2)) | (s + w >= 3), "technical").otherwise("plan")


def vocabulary_share(words: Column, vocabulary: Sequence[str]) -> Column:
    """share of the vocabulary that stands among the words, in the singular or with an s."""
    return sum((F.when(F.array_contains(words, v) | F.array_contains(words, f"{v}s"), 1).otherwise(0) for v in vocabulary), F.lit(0)) / len(vocabulary)


# Prefixes of field names and their families.
FAMILIES = (("dim_", "dimension"), ("mat_", "material"), ("opt_", "option"), ("ref_", "reference"))


def field_family(name: Column, default: str = "header") -> Column:
    """the family a field's thresholds are kept under."""
    out = F.lit(default)
    for prefix, family in reversed(FAMILIES):
        out = F.when(name.startswith(prefix), family).otherwise(out)
    return out


def category(folder: Column, template: Column, names: Sequence[str], default: str = "other") -> Column:
    """what the folder's name says, else the template's category, else the default."""
    told = F.lit(None).cast("string")
    for n in reversed(names):
        told = F.when(F.contains(search_key(folder), F.lit(n)), n).otherwise(told)
    return F.coalesce(told, template, F.lit(default))


def code_from_name(file: Column, folder: Column) -> Column:
    """the reference at the start of the file's name, else of its folder's; its two parts may be parted by one sign."""

    def of(name: Column) -> Column:
        begin = F.regexp_extract(F.upper(name), "^([A-Z]+[-_ ]?[0-9]+|[0-9]+[-_ ]?[A-Z]+)(?![A-Za-z0-9])", 1)
        key = F.regexp_replace(begin, "[-_ ]", "")
        return F.when(has_reference_shape(key), key)

    return F.coalesce(of(file), of(folder))


def dimension_asked(text: Column) -> Column:
    """R14 in bulk: struct (value, unit) of the first decimal or number with a unit; bare integers are none."""
    pattern = "(?i)(?<![0-9.,])([0-9]+[.,][0-9]+|[0-9]+(?=\\s*(?:mm|cm|m|kg|g)\\b))\\s*(mm|cm|m|kg|g)?\\b"
    value = _double(F.regexp_extract(text, pattern, 1))
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.nullif(F.lower(F.regexp_extract(text, pattern, 2)), F.lit("")).alias("unit")))


def common_value(value: Column, unit: Column) -> Column:
    """Metres for lengths (no unit: metres), kilograms for weights."""
    out = value
    for name, metres in METRES.items():
        out = F.when(unit == name, value * metres).otherwise(out)
    return F.round(F.when(unit == "g", value / 1000).otherwise(out), 6)
