"""Text keys, tokens and trigram similarity as column expressions (no Python on executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .query import REFERENCE

# Letters with marks, and what they fold to.
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
_SPACES = "[\\s\\u00a0\\u202f\\u2007]+"
_COMBINING = "[\\u0300-\\u036f]"


def collapse(text: Column) -> Column:
    """All white space, non-breaking too, to single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def strip_accents(text: Column) -> Column:
    """Lower case without marks, whether composed or combining; ligatures stay."""
    return F.translate(F.regexp_replace(F.lower(text), _COMBINING, ""), _MARKED, _PLAIN)


def search_key(text: Column) -> Column:
    """Fold for searching (F01): case, marks, ligatures, sharp s, white space. Null gives ''."""
    key = strip_accents(F.coalesce(text, F.lit("")))
    # Ligatures and what they are written as.
    for ligature, letters in (("œ", "oe"), ("æ", "ae"), ("ß", "ss")):
        key = F.replace(key, F.lit(ligature), F.lit(letters))
    return collapse(key)


def title_key(text: Column) -> Column:
    """Fold for titles (F02): as ``strip_accents`` with white space collapsed."""
    return collapse(strip_accents(F.coalesce(text, F.lit(""))))


def variant_key(text: Column) -> Column:
    """Grouping key of spelling variants (F03): folded, anything but letters and digits is a space."""
    return F.trim(F.regexp_replace(search_key(text), "[^0-9a-z]+", " "))


def canonical_form(text: Column) -> Column:
    """collapsed, without punctuation at the ends; null if nothing is left."""
    cleaned = F.regexp_replace(collapse(text), "^[\\s,;:./]+|[\\s,;:./]+$", "")
    return F.when(cleaned != "", cleaned)


def reference_key(text: Column) -> Column:
    """upper-case letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def has_reference_shape(key: Column) -> Column:
    """whether the whole key looks like a reference."""
    return key.rlike(f"^{REFERENCE}$")


def model_key(text: Column) -> Column:
    """model names; abbreviations with a dot are spelled out, decimal points kept, letters and digits parted."""
    key = search_key(text)
    # Abbreviations of builders.
    for short, full in (("bav", "bavaria"), ("ben", "beneteau"), ("duf", "dufour"), ("jan", "jeanneau")):
        key = F.regexp_replace(key, f"(?<![\\w]){short}\\.(?=\\s|$)", full)
    key = F.regexp_replace(key, "(?<=[0-9])[.,](?=[0-9])", "\u0001")
    key = F.regexp_replace(key, "[^\\p{L}\\p{N}\u0001]+", " ")
    key = F.replace(key, F.lit("\u0001"), F.lit("."))
    key = F.regexp_replace(key, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    return F.trim(F.regexp_replace(key, " +", " "))


def separators_to_spaces(text: Column) -> Column:
    """Hyphens, underscores and slashes part words."""
    return F.regexp_replace(text, "[-_/]+", " ")


def tokens(text: Column) -> Column:
    """Folded words of letters and digits; no stemming, no stop words."""
    return F.filter(F.split(F.regexp_replace(search_key(text), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")


def ordered_trigrams(text: Column) -> Column:
    """The trigrams of each word of letters and digits in the order they stand, repeats included; words are padded by two spaces before and one after."""
    return F.flatten(
        F.transform(
            tokens(text),
            lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
        )
    )


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    return F.array_distinct(ordered_trigrams(text))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays; 0 for two empty ones."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(shared / F.nullif(every, F.lit(0)))


def word_similarity(query: Column, text: Column, least: float = 0.3) -> Column:
    """the greatest similarity of the query's trigrams to any continuous extent of the text's ordered trigrams.

    0 below ``least``, which bounds how many different trigrams an extent may have. Extents that end at one
    place differ by the trigrams met last, so it is enough to keep those, latest last: time is linear in
    the text. Only ends that are trigrams of the query are scored. An empty query or text gives 0.
    """
    of = lambda count, width, size: F.try_divide(count, size + width - count)

    def best_extent(own: Column) -> Column:
        size = F.size(own)
        most = F.greatest(F.floor(size / least).cast("int"), F.lit(1))

        def ending_here(recent: Column) -> Column:
            start = F.struct(F.lit(0).alias("width"), F.lit(0).alias("count"), F.lit(0.0).alias("best"))

            def longer(s: Column, g: Column) -> Column:
                count = s["count"] + F.array_contains(own, g).cast("int")
                return F.struct((s["width"] + 1).alias("width"), count.alias("count"), F.greatest(s["best"], of(count, s["width"] + 1, size)).alias("best"))

            return F.aggregate(F.reverse(recent), start, longer, lambda s: s["best"])

        def step(s: Column, g: Column) -> Column:
            kept = F.array_remove(s["recent"], g)
            recent = F.concat(F.slice(kept, F.greatest(F.size(kept) - most + 2, F.lit(1)), most), F.array(g))
            moved = lambda r: F.struct(r.alias("recent"), F.when(F.array_contains(own, g), F.greatest(s["best"], ending_here(r))).otherwise(s["best"]).alias("best"))
            return _once(recent, moved)

        start = F.struct(F.array().cast("array<string>").alias("recent"), F.lit(0.0).alias("best"))
        return F.aggregate(ordered_trigrams(text), start, step, lambda s: s["best"])

    return _once(_once(trigrams(query), best_extent), lambda found: F.when(found >= least - 1e-12, found).otherwise(0.0))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def french_number(value: Column, digits: int = 2) -> Column:
    """F16: comma as the decimal sign, thin groups of three."""
    return F.translate(F.format_number(value, digits), ",.", " ,")
