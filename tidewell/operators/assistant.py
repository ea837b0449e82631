"""Rule-based question answering: a question becomes an intent, an intent a small plan."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.query import plain

LEAST_WORD, HINTS, CITED = 3, 3, 20


@dataclass(frozen=True)
class Answer:
    """``state``: ok, ambiguous or no_source; ``rows`` are what the answer rests on."""

    state: str
    intent: str
    rows: DataFrame | None


@dataclass(frozen=True)
class Intent:
    """``pattern`` is searched in the folded question; ``plan`` turns its groups into rows.

    ``agree`` names the column whose values must all be equal for a clear answer.
    """

    name: str
    pattern: str
    plan: Callable[..., DataFrame]
    agree: str | None = None


def ask(question: str, intents: list[Intent], fallback: Callable[[list[str]], DataFrame]) -> Answer:
    """The first intent, in order, that recognises the question and finds rows; else hints from its words.

    Only the number of distinct answers reaches the driver, never the rows.
    """
    folded = " ".join(plain(question).split())
    for intent in intents:
        m = re.search(intent.pattern, folded)
        if not m:
            continue
        rows = intent.plan(**m.groupdict())
        values = rows.select(intent.agree).distinct().limit(2).count() if intent.agree else rows.limit(1).count()
        if values:
            return Answer("ambiguous" if intent.agree and values > 1 else "ok", intent.name, rows)
    words = [w for w in re.findall(r"\w+", folded) if len(w) >= LEAST_WORD]
    return Answer("no_source", "fallback", fallback(words).limit(HINTS))


def value_of(df: DataFrame, key: str, code: str, column: str, preferred: str, first: str) -> DataFrame:
    """One column of a record in all its measure sets, the preferred set first."""
    return df.where(F.lower(F.col(key).cast("string")) == code.lower()).select(key, preferred, F.col(column).alias("value")).where("value IS NOT NULL").orderBy(F.desc(F.col(preferred) == first), preferred)


def codes_between(df: DataFrame, key: str, column: str, low: float, high: float) -> DataFrame:
    """R28."""
    return df.where(F.col(column).between(low, high)).select(key, F.col(column).alias("value")).orderBy("value", key)


def attached_to(df: DataFrame, key: str, owner: str, name: str) -> DataFrame:
    """Records of an owner whose name contains the text, case aside."""
    return df.where(F.contains(F.lower(owner), F.lit(name.lower()))).select(key, owner).orderBy(key)


def counted(df: DataFrame, key: str, kind: str, motif: str, year: int, at: str) -> tuple[DataFrame, DataFrame]:
    """How many of a kind in a year, and the first ones counted."""
    hit = df.where(F.contains(F.lower(kind), F.lit(motif.lower())) & (F.year(at) == year))
    return hit.agg(F.count("*").alias("n")), hit.orderBy(key).limit(CITED).select(key, kind)


def interpretations(parts: dict[str, DataFrame]) -> DataFrame:
    """An ambiguous word answered under each of its meanings."""
    out = None
    for meaning, df in parts.items():
        rows = df.select(F.lit(meaning).alias("meaning"), F.col(df.columns[0]).cast("string").alias("key"), F.col(df.columns[1]).cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def option_of(df: DataFrame, key: str, code, option: str, flag: str, text: str) -> DataFrame:
    """A yes-or-no or textual option; words for 'not applicable' stay as they are."""
    return df.where((F.col(key) == code) & (F.col("option") == option)).select(key, F.coalesce(F.col(text), F.when(F.col(flag), "yes").otherwise("no")).alias("value"))


def attribute_of(df: DataFrame, key: str, band: str, value: str, attributes: list[str]) -> DataFrame:
    """Attributes of the records of a band (or of one code): key, attribute, value of each that is known."""
    entries = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    return df.where(F.col(band) == value).select(key, F.inline(entries)).where("value IS NOT NULL")


# Words that say that an option does not apply.
NOT_APPLICABLE = ("not applicable", "n/a", "none", "sans objet")


def verbatim(df: DataFrame, key: str, told: str) -> DataFrame:
    """Values as they were told; words for 'not applicable' are kept, in small letters, and are never numbers."""
    low = F.lower(F.trim(told))
    return df.select(key, F.when(low.isin(*NOT_APPLICABLE), low).otherwise(F.col(told)).alias("value"))


def header_field(df: DataFrame, key: str, code, asked: str, fields: dict[str, str]) -> DataFrame:
    """One header field of a code, by the name it is asked by; unknown names find nothing."""
    column = fields.get(asked)
    if column is None:
        return df.where("false").select(key, F.lit(asked).alias("field"), F.lit(None).cast("string").alias("value"))
    return df.where(F.col(key) == code).select(key, F.lit(column).alias("field"), F.col(column).cast("string").alias("value"))
