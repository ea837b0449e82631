"""The hybrid search as one object: analysed query in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import query as P
from ..functions import text as T
from . import compare, retrieval
from .latest import page


@dataclass(frozen=True)
class SearchResult:
    """Nothing has run yet: the caller writes or shows what it needs."""

    page: DataFrame
    facets: DataFrame
    total: DataFrame
    total_exact: bool
    sources: tuple[str, ...]


@dataclass(frozen=True)
class HybridSearch:
    """A corpus with its key, its text by weight class, facet axes, dimensions and optional vectors."""

    corpus: DataFrame
    key: str
    weighted: dict[str, Column]
    codes: Sequence[Column]
    axes: Sequence[str]
    dims: Sequence[str] = ()
    recent: Column | None = None
    embedding: str | None = None
    encode: Callable[[str], list[float]] | None = None

    def run(self, text: str, filters: dict[str, str] | None = None, offset: int = 0, limit: int = 20) -> SearchResult:
        """Sources that the query calls for are ranked, fused and promoted; an empty query browses by date.

        The total is exact unless a fuzzy source voted (then it is a lower bound, as flagged).
        """
        filters = {k: v for k, v in (filters or {}).items() if k in self.axes}
        spec = P.parse_query(T_clean(text))
        kept = self.corpus.where(reduce(lambda a, b: a & b, [F.col(k).cast("string") == v for k, v in filters.items()], F.lit(True)))
        if spec.dimension and self.dims:
            value = spec.dimension.for_dimension(spec.dimension.name) if spec.dimension.name else spec.dimension.common()
            low, high = P.bounds(value)
            kept = kept.where(compare.any_within([spec.dimension.name] if spec.dimension.name in self.dims else self.dims, low, high))
            spec = P.parse_query(spec.dimension.rest)
        n = retrieval.depth(offset, limit)
        matched = kept
        if not (spec.required or spec.phrases or spec.reference):
            order = [self.recent.desc_nulls_last()] if self.recent is not None else []
            rows = page(kept, [*order, F.asc(self.key)], offset, limit)
            return SearchResult(rows, retrieval.facets(self.corpus, self.axes, filters), kept.agg(F.count("*").alias("total")), True, ("browse",))
        words = F.concat(*self.weighted.values())
        matched = kept.where(retrieval.matches(words, spec))
        parts = {"lexical": retrieval.lexical(kept, self.key, self.weighted, spec)}
        exact = retrieval.reference(kept, self.key, self.codes, spec.reference)
        fuzzy = len(spec.required) == 1 and not spec.phrases
        if fuzzy:
            parts["trigram"] = retrieval.trigram(kept, self.key, F.array_join(words, " "), spec.required[0])
        if self.embedding and self.encode:
            query = F.array(*[F.lit(float(x)) for x in self.encode(text)])
            parts["vector"] = retrieval.vector(kept, self.key, self.embedding, query, n)
        if spec.reference:
            parts["reference"] = exact
        fused = retrieval.promote(retrieval.fuse([retrieval.ranked(s, n) for s in parts.values()]), exact)
        best = page(fused, [F.desc("exact"), F.desc("score"), F.asc("id")], offset, limit)
        rows = self.corpus.join(F.broadcast(best), F.col(self.key) == F.col("id"))  # a page: ``limit`` rows
        total = matched.select(self.key).unionByName(exact.select(F.col("id").alias(self.key))).distinct().agg(F.count("*").alias("total"))
        return SearchResult(rows, retrieval.facets(self.corpus.join(matched.select(self.key), self.key, "left_semi"), self.axes, filters), total, not (fuzzy or "vector" in parts), tuple(parts))


def T_clean(text: str) -> str:
    """R17 on the driver: separators inside words part them, so that a hyphen is not taken for NOT."""
    import re

    return re.sub(r"(?<=\w)[-_/]+(?=\w)", " ", text)


def journal_row(spark, text: str, filters: dict[str, str], results: int, at) -> DataFrame:
    """One row a query for the journal."""
    import json

    return spark.createDataFrame([(text, json.dumps(filters, sort_keys=True), results, at)], "query string, filters string, results long, created_at timestamp")


def search_text(records: DataFrame, key: str, code: Column, title: Column, fields: Sequence[Column], notes: Column, dims: Sequence[str]) -> DataFrame:
    """Weighted text A, B, C of every record in one pass; dimensions are told with dot and comma."""
    told = [F.format_string("%.2f", F.col(d).cast("double")) for d in dims]
    numbers = [x for n, d in zip(told, dims, strict=True) for x in (F.when(F.col(d).isNotNull(), n), F.when(F.col(d).isNotNull(), F.translate(n, ".", ",")))]
    a = F.concat_ws(" ", T.separators_to_spaces(code), title)
    return records.select(key, a.alias("a"), F.concat_ws(" ", *fields, *numbers).alias("b"), F.coalesce(notes, F.lit("")).alias("c"))


def citations(answers: DataFrame, traces: DataFrame) -> DataFrame:
    """Each answer's trace by (record, field, rank), else the one without a rank."""
    exact = traces.where("rank IS NOT NULL").select("record", "field", "rank", F.col("page").alias("__exact"))
    general = traces.where("rank IS NULL").select("record", "field", F.col("page").alias("__general"))
    return answers.join(exact, ["record", "field", "rank"], "left").join(general, ["record", "field"], "left").select("record", "field", "rank", F.coalesce("__exact", "__general").alias("page"))
