"""White-listed filters built from a request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class FilterSpec:
    """What a request may ask for. Keys that no field names are ignored; bounds that are no numbers too.

    ``equal``: key -> column compared as it is (P03); ``contains``: key -> column searched without case
    and accents (P04), so that ``%`` and ``_`` are plain characters; ``year``: key -> date column, asked as
    a year or as ``first-last`` (P06); ``ranges``: dimension -> column, asked by ``min_<dimension>`` and
    ``max_<dimension>`` (P07); ``within``: key -> (table, its column, own column), a semi-join (P05).
    """

    equal: Mapping[str, str] = field(default_factory=dict)
    contains: Mapping[str, str] = field(default_factory=dict)
    year: Mapping[str, str] = field(default_factory=dict)
    ranges: Mapping[str, str] = field(default_factory=dict)
    within: Mapping[str, tuple[DataFrame, str, str]] = field(default_factory=dict)


def _number(value) -> float | None:
    try:
        return float(str(value).replace(",", "."))
    except ValueError:
        return None


def apply(df: DataFrame, spec: FilterSpec, asked: Mapping[str, object]) -> DataFrame:
    """The rows of ``df`` that pass all that is asked and allowed."""
    tests: list[Column] = [F.lit(True)]
    for key, value in asked.items():
        if value is None or value == "":
            continue
        if key in spec.equal:
            tests.append(F.col(spec.equal[key]) == value)
        elif key in spec.contains:
            tests.append(F.contains(T.search_key(F.col(spec.contains[key])), T.search_key(F.lit(str(value)))))
        elif key in spec.year:
            first, _, last = str(value).partition("-")
            if first.isdigit() and (last or first).isdigit():
                tests.append(F.year(spec.year[key]).between(int(first), int(last or first)))
        elif key[:4] in ("min_", "max_") and key[4:] in spec.ranges and (bound := _number(value)) is not None:
            column = F.col(spec.ranges[key[4:]])
            tests.append(column >= bound if key.startswith("min_") else column <= bound)
    kept = df.where(reduce(lambda a, b: a & b, tests))
    for key, (table, theirs, own) in spec.within.items():
        if asked.get(key):
            kept = kept.join(table.select(F.col(theirs).alias(own)), own, "left_semi")
    return kept


def with_status(df: DataFrame, status: str, open_too: bool, valid: str, pending: str) -> DataFrame:
    """Valid rows, with pending ones if asked for; no others ever."""
    return df.where(F.col(status).isin(valid, pending) if open_too else F.col(status) == valid)


def like_escaped(column: Column, typed: str) -> Column:
    """Contains what was typed, case aside, through LIKE with the wildcards escaped."""
    for sign in ("\\", "%", "_"):
        typed = typed.replace(sign, f"\\{sign}")
    return column.ilike(f"%{typed}%")


def any_like(columns: Sequence[str], typed: str) -> Column:
    """One of several columns contains what was typed."""
    return reduce(lambda a, b: a | b, [F.coalesce(like_escaped(F.col(c).cast("string"), typed), F.lit(False)) for c in columns])


def known_column(name: str, allowed: Sequence[str]) -> str:
    """The name, if it is on the closed list; anything else is refused before a plan is built."""
    if name not in allowed:
        raise ValueError(f"unknown column {name!r}")
    return name
