"""Operator 7: license scans as an exact set-similarity join.

Text blocks (windows of ``width`` words, every ``width // 2``, and the end of the text) are
joined with license templates: block and template match if the block holds at least
``threshold`` of the template's distinct words. The join is exact and uses three filters on
words in one global order, rarest in the corpus first:

* prefix: a match must hold one of the template's first ``n - needed + 1`` words;
* length: a block with fewer than ``needed`` distinct words cannot match;
* position: words matched so far plus those left in the template must reach ``needed``.

The templates are a constant of the program, so their index is small and fixed; the corpus'
word frequencies are counted over all documents, for template words only.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# The contract's phrases and labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Opening sentences of public licenses, as their texts have them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-notice", "this work is licensed under a creative commons attribution international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
WIDTH, THRESHOLD = 64, 0.8

# A-Z become small; everything that is no word byte becomes a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def blocks(n: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """Windows over ``n`` words; every word is in one, the last ends with the text."""
    if n <= width:
        return [(0, n)] if n else []
    step = max(1, width // 2)
    starts = list(range(0, n - width + 1, step))
    return [(s, s + width) for s in starts] + ([(n - width, n)] if starts[-1] + width < n else [])


class TemplateIndex:
    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        rank = lambda w: (frequency.get(w, 0), w)
        self.sets = [(name, sorted({*text.encode().split()}, key=rank)) for name, text in templates]
        self.needed = [ceil(threshold * len(ws) - 1e-9) for _, ws in self.sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, ws) in enumerate(self.sets):
            for position, w in enumerate(ws[: len(ws) - self.needed[k] + 1]):
                self.prefix.setdefault(w, []).append((k, position))

    def matches(self, ws: list[bytes], width: int) -> dict[int, float]:
        """Template -> its best containment over all blocks, where it reaches the threshold."""
        hits = [i for i, w in enumerate(ws) if w in self.prefix] if not self.prefix.keys().isdisjoint(ws) else []
        best: dict[int, float] = {}
        if not hits:
            return best
        nearest = 0
        for start, end in blocks(len(ws), width):
            while nearest < len(hits) and hits[nearest] < start:
                nearest += 1
            if nearest == len(hits) or hits[nearest] >= end:
                continue
            block = set(ws[start:end])
            first: dict[int, int] = {}
            for w in block & self.prefix.keys():
                for k, position in self.prefix[w]:
                    first[k] = min(position, first.get(k, position))
            for k, position in first.items():
                own = self.sets[k][1]
                # the words before ``position`` are known to be absent
                if len(block) < self.needed[k]:
                    continue
                overlap, left = 0, len(own) - position
                for w in own[position:]:
                    overlap += w in block
                    left -= 1
                    if overlap + left < self.needed[k]:
                        break
                if overlap >= self.needed[k]:
                    best[k] = max(best.get(k, 0.0), overlap / len(own))
        return best


def phrase_places(ws: list[bytes], phrases) -> list[tuple[str, list[int]]]:
    """Per phrase its label and the word positions where it starts (overlaps count)."""
    line, out = b" " + b" ".join(ws) + b" ", []
    for phrase, label in phrases:
        needle, at, places = b" " + phrase.encode() + b" ", -1, []
        word, counted = 0, 0
        while (at := line.find(needle, at + 1)) >= 0:
            word += line.count(b" ", counted, at)
            counted = at
            places.append(word)
        out.append((label, places))
    return out


def template_frequency(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How often each template word stands in the whole corpus: one row for each task, of a few hundred counts at most."""
    bounded_batches(docs.sparkSession)
    vocabulary = sorted({w for _, text in templates for w in text.encode().split()})

    def run(batches):
        total = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = Counter(tokens(text))
                for w in vocabulary:
                    total[w] += counts.get(w, 0)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in vocabulary]), pa.array([total[w] for w in vocabulary], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in rows.collect()}  # at most as many rows as the templates have words


OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: places of the phrases, labels of phrases and of matched templates, best containment.

    A null or empty text has no words, no labels and score 0; an empty table gives an empty
    one; repeated rows are answered each. A phrase scores 1, a template its containment.
    """
    frequency = template_frequency(docs, templates)
    bounded_batches(docs.sparkSession)
    index = TemplateIndex(templates, frequency, threshold)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ws = tokens(text)
                found = phrase_places(ws, phrases)
                places = [p for _, ps in found for p in ps]
                base = sorted({label for label, ps in found if ps})
                matched = index.matches(ws, width)
                own = sorted({*base, *(templates[k][0] for k in matched)})
                score = 1.0 if base else max(matched.values(), default=0.0)
                rows.append((len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(own), score))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(x.split()[0] for x in OUT.split(", "))])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, {OUT}")


def op7_license_scan(spark, sf_dir) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
