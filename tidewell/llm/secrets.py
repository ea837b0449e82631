"""Operator 2: secret scans with one combined deterministic automaton.

All rules are compiled by subset construction and minimisation into transition arrays and run
over each text's bytes in one pass (``automaton.Scanner``). Rules are pure ASCII, so matching
UTF-8 bytes equals matching code points; offsets are turned into code points afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Scanner
from .common import bounded_batches


@dataclass(frozen=True)
class Rule:
    """A match counts if what follows the last character of ``after`` (whole match if empty) has ``least`` characters.

    ``pattern`` may already ask for a part of ``least`` where runs are maximal, so that the
    automaton stays quiet on ordinary words.
    """

    kind: str
    pattern: str
    least: int
    fold_case: bool = False
    value_of: str = ""


# The contract's three base rules, then this operator's own.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True, r"""^[^:=]*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner([(r.pattern, r.fold_case) for r in rules])


def find(text: str | None, rules: tuple[Rule, ...], compiled: Scanner) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by the order of ``rules``."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    kept = []
    for k, start, end in compiled.scan(data):
        rule, match = rules[k], data[start:end].decode("ascii")
        if rule.value_of:
            match = match[re.match(rule.value_of, match).end() :]
        if len(match) >= rule.least:
            kept.append((start, k, end))
    kept.sort()
    if len(data) == len(text):
        return [(rules[k].kind, start, end) for start, k, end in kept]
    if not kept:
        return []
    # code points before each byte: all bytes but continuations begin one
    points = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80) - 1
    return [(rules[k].kind, a := int(points[start]), a + end - start) for start, k, end in kept]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and all spans of secrets of every whole text, sorted by start, then kind.

    One row out for each row in, so repeated rows and ids stay; a null or empty text has no
    spans, an empty table gives an empty one. No shuffle: a lost task is simply run again.
    """
    bounded_batches(docs.sparkSession)
    compiled = scanner(rules)  # on the driver, once; the arrays travel with the task
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, rules, compiled)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], ["doc_id", "spans"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, spans {SPANS}")


def digest(spans: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts per base kind, hash of the base spans and all spans as text."""
    told = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return spans.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(told(of(*base)), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def op2_secret_scan(spark, sf_dir) -> DataFrame:
    return digest(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE_KINDS)
