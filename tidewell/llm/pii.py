"""Operator 10: personal data by bootstrapped contextual extraction, on DataFrame functions only.

1. Base kinds are matched by regular expressions inside the JVM; places are sums of lengths of
   the matches and of the pieces between them.
2. Every identifier-like token (one with a digit or ``@``) is a candidate; its lexical pattern
   is the two words before it, of which earlier candidates are told as ``<id>``. Candidates that
   touch a base span are seeds of its kind; spans and candidates meet by an equality join on row
   and block of text.
3. The bipartite graph of distinct (pattern, instance) edges is scored in rounds: a pattern's
   score for a kind is the share of its instances that are believed to be of that kind, damped
   by how many there are; an instance's belief is the noisy-or of its patterns' scores.
4. Candidates of patterns above the threshold that are no seeds become spans ``ctx_<kind>``.

The text is read once; what is kept from it (spans and candidates of a row) is written to the
shared folder, so the rounds and the join back move no text. Edges are distinct and sums are
pre-aggregated, so a very common line counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, LEAST_SCORE, LEAST_SEEDS = 3, 0.6, 3
FOLD, REACH = 128, 64  # places in a fold, code points in a block of text

# The contract's patterns, in forms that find the same matches without long
# backtracking. A local part starts where the last match ended or after another character; a
# card is a maximal run of digits with single separators.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def worth(i: Column) -> Column:
        x = F.substr(d, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(m: Column) -> Column:
    return m.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")


_RULES: tuple[tuple[str, str, str, object], ...] = (
    ("email", _EMAIL, "@", lambda m: F.lit(True)),
    ("ip", _IP, ".", _small_parts),
    ("card", _CARD, "", _luhn),
    ("phone", _PHONE, "+", lambda m: F.length(_digits(m)).between(10, 15)),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, wherever it stands in ``body`` (functions of a lambda are not shared)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends(lengths: Column) -> Column:
    """Sums of an array of ints up to and with each place.

    A fold that appends copies its array at every step, so it runs over blocks of ``FOLD``
    places, whose own sums are folded likewise: time in proportion for any real text.
    """
    add = lambda a, x: a + x
    empty = F.array().cast("array<int>")

    def fold(values: Column, start: Column) -> Column:
        step = lambda done, x: F.struct((done["at"] + x).alias("at"), F.array_append(done["out"], done["at"] + x).alias("out"))
        return F.aggregate(values, F.struct(start.alias("at"), empty.alias("out")), step, lambda done: done["out"])

    def within(blocks: Column) -> Column:
        sums = fold(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add)), F.lit(0))
        starts = F.concat(F.array(F.lit(0)), sums)
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("s")), lambda x: F.when(x["b"].isNotNull(), fold(x["b"], x["s"])).otherwise(empty)))

    cut = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(FOLD)), lambda at: F.slice(v, at, FOLD))
    return _let(lengths, lambda v: F.when(F.size(v) > 0, _let(cut(v), within)).otherwise(empty))


def _places(text: Column, regex: str, needle: str) -> Column:
    """array<struct<start,end,m,gap>> of all matches: code points, the match and the text before it."""
    # the last piece has no match after it
    pairs = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(regex), 0).alias("m"), F.split(text, regex, -1).alias("gap")), lambda x: x["m"].isNotNull())
    found = _let(
        pairs,
        lambda p: F.transform(
            F.arrays_zip(p.alias("p"), _ends(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["m"]))).alias("e")),
            lambda x: F.struct((x["e"] - F.length(x["p"]["m"])).alias("start"), x["e"].alias("end"), x["p"]["m"].alias("m"), x["p"]["gap"].alias("gap")),
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int,m:string,gap:string>>")
    return F.when(F.contains(text, F.lit(needle)) if needle else text.rlike("[0-9]"), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    """array<struct<start,k,kind,end>> by start, then kind; failing matches are dropped."""

    def of(k: int, kind: str, regex: str, needle: str, passes) -> Column:
        kept = F.filter(_places(text, regex, needle), lambda x: passes(x["m"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    return F.sort_array(F.flatten(F.array(*[of(k, *rule) for k, rule in enumerate(_RULES)])))


_LAST = r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+([^\x20\x09-\x0D]+))?"


def candidates(text: Column) -> Column:
    """array<struct<start,end,first,last,instance,pattern>>: the token's place, its place without punctuation, both words.

    The pattern is null where two words do not stand before the token, or nothing but
    punctuation is in it.
    """
    def words(x: Column) -> Column:
        """A found token with the two last words before it, read from the end, so that a long gap costs one reversal."""
        last = lambda tail: F.struct(x.alias("x"), F.reverse(F.regexp_extract(tail, _LAST, 1)).alias("near"), F.reverse(F.regexp_extract(tail, _LAST, 2)).alias("far"))
        return _let(F.reverse(x["gap"]), last)

    def with_before(found: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(found, lambda e: e["near"]))
        return F.transform(F.filter(F.arrays_zip(found.alias("e"), before.alias("before")), lambda z: z["e"].isNotNull()), one)

    def one(e: Column, k: Column) -> Column:
        x, near, far, held = e["e"]["x"], e["e"]["near"], e["e"]["far"], F.lit("<id>")
        # two words of the gap; or one and the token before; or that token and the word before it
        older = F.when(e["before"] != "", e["before"]).when(k > 1, held)
        pattern = F.when(far != "", F.concat_ws(" ", far, near)).when(near != "", F.when(k > 0, F.concat_ws(" ", held, near))).when((k > 0) & older.isNotNull(), F.concat_ws(" ", older, held))
        # punctuation around a token is not part of it
        lead = F.length(F.regexp_extract(x["m"], r"^[^\p{L}0-9+@]*", 0))
        core = F.regexp_replace(x["m"], r"^[^\p{L}0-9+@]+|[^\p{L}0-9]+$", "")
        return F.struct(
            (x["start"] + lead).cast("int").alias("start"), (x["start"] + lead + F.length(core)).cast("int").alias("end"), x["start"].alias("first"), x["end"].alias("last"),
            F.lower(core).alias("instance"), F.when(core != "", F.lower(pattern)).alias("pattern"),
        )

    return F.filter(_let(F.transform(_places(text, _CANDIDATE, ""), words), with_before), lambda c: c["pattern"].isNotNull())


def seeds(found: DataFrame, base: DataFrame) -> DataFrame:
    """The rows of ``found`` with ``kind``, that of the first base span each touches, if any; those a span began before go.

    ``found``: row, start, end, first, last, ...; ``base``: row, start, k, kind, end.
    """
    blocks = lambda start, end: F.explode(F.sequence(F.floor(start / REACH), F.floor((end - 1) / REACH)))
    spans = base.select("row", F.col("start").alias("s"), "k", "kind", F.col("end").alias("e"), blocks(F.col("start"), F.col("end")).alias("block"))
    places = found.select("row", "first", "last", blocks(F.col("first"), F.col("last")).alias("block"))
    met = places.join(spans, ["row", "block"]).where((F.col("s") < F.col("last")) & (F.col("e") > F.col("first")))
    touched = met.groupBy("row", "first").agg(F.min(F.struct("s", "k", "kind")).alias("span"))
    whole = found.join(touched, ["row", "first"], "left").where(F.col("span").isNull() | (F.col("span.s") >= F.col("first")))
    return whole.select("row", "start", "end", "instance", "pattern", F.col("span.kind").alias("kind"))


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """pattern, kind, score of the patterns above the threshold. ``edges``: distinct pattern, instance, kind (null: not a seed).

    Round 1 believes in seeds only; later rounds also in what patterns found the round before.
    """
    seeds = edges.where("kind IS NOT NULL").groupBy("instance", "kind").agg(F.lit(1.0).alias("belief"))
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("size"))
    pairs = edges.select("pattern", "instance").distinct()
    belief, scores = seeds, None
    for n in range(rounds):
        believed = pairs.join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.count("*").alias("hits"))
        own = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("seeds"))
        scored = believed.join(own, ["pattern", "kind"]).join(sizes, "pattern")
        score = (F.col("mass") / F.col("size")) * (1 - F.pow(F.lit(0.5), F.col("mass")))
        scored = scored.withColumn("score", score).where((F.col("seeds") >= least_seeds) & (F.col("score") >= least_score))
        scores = Table(scored.select("pattern", "kind", "score"), f"patterns{n}").df
        if n + 1 < rounds:
            # noisy-or over an instance's patterns; logarithms make it a sum
            heard = pairs.join(scores, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))).alias("belief"))
            both = seeds.unionByName(heard).groupBy("instance", "kind").agg(F.max("belief").alias("belief"))
            belief = Table(both, f"beliefs{n}").df
    return scores


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """doc_id and spans, array<struct<start,k,kind,end>> by start, then kind, of every row.

    Null and empty texts have none; repeated rows are answered each (a row number is written
    with them); a null id is kept. An empty table gives an empty one. Of two patterns for one
    candidate the better one's kind is taken, at ties the smaller kind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), base_spans(text).alias("base"), candidates(text).alias("found"))
    kept = Table(rows, "personal").df
    # of base spans only those beside candidates matter, and of rows only those with both
    both = kept.where((F.size("base") > 0) & (F.size("found") > 0))
    alone = kept.where(F.size("base") == 0).select("row", F.inline("found")).select("row", "start", "end", "instance", "pattern", F.lit(None).cast("string").alias("kind"))
    named = Table(seeds(both.select("row", F.inline("found")), both.select("row", F.inline("base"))).unionByName(alone), "candidates").df
    edges = Table(named.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")), "pattern_edges").df
    scores = pattern_scores(edges, rounds, least_score, least_seeds)
    best = scores.groupBy("pattern").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("named"))
    fresh = named.where("kind IS NULL").join(best, "pattern")
    order = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, len(KINDS) + k)]), F.col("named"))
    item = F.struct("start", order.cast("int").alias("k"), F.concat(F.lit("ctx_"), "named").alias("kind"), "end")
    added = fresh.groupBy("row").agg(F.collect_list(item).alias("added"))
    whole = kept.select("doc_id", "row", "base").join(added, "row", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))
    return whole.select("doc_id", spans.alias("spans"))


def op10_personal_data(spark, sf_dir) -> DataFrame:
    from .secrets import digest

    return digest(find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS)
