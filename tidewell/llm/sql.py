"""DuckDB SQL of the operators that SQL can express, over the same whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _spans(rules: list[tuple[str, str, str]]) -> str:
    """CTE ``s(doc, kind, k, start, stop)`` of matches that pass, from (kind, regex, condition on ``m``).

    Positions: the pieces between matches and the matches before one, by length in code points.
    """
    parts = []
    for k, (kind, regex, keep) in enumerate(rules):
        quoted = regex.replace("'", "''")
        parts.append(f"""
        SELECT doc, '{kind}' AS kind, {k} AS k, ms[i] AS m,
               (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
        FROM (SELECT doc, ms, gaps, unnest(range(1, len(ms) + 1)) AS i
              FROM (SELECT doc, regexp_extract_all(text, '{quoted}') AS ms, string_split_regex(text, '{quoted}') AS gaps
                    FROM d WHERE regexp_matches(text, '{quoted}')))
        WHERE {keep.format(m="ms[i]")}""")
    return f"""d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc, kind, k, start, start + length(m) AS stop FROM ({" UNION ALL ".join(parts)}))"""


def _digest(base: list[str], rules: list[tuple[str, str, str]]) -> str:
    counts = ", ".join(f"count(s.k) FILTER (WHERE s.kind = '{b}')::BIGINT AS n_{b}" for b in base)
    told = "string_agg(s.kind || ':' || s.start || ':' || s.stop, ',' ORDER BY s.start, s.k)"
    kinds = ", ".join(f"'{b}'" for b in base)
    return f"""WITH {_spans(rules)}
SELECT any_value(d.doc_id) AS doc_id, {counts},
       sha256(coalesce({told} FILTER (WHERE s.kind IN ({kinds})), '')) AS base_sha256,
       coalesce({told}, '') AS spans
FROM d LEFT JOIN s ON d.doc = s.doc GROUP BY d.doc"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ORACLES["op2_secret_scan"] = _digest(
    ["assign", "access", "hex"],
    [
        ("assign", _ASSIGN, r"""length(regexp_extract({m}, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 6"""),
        ("access", "AKIA[A-Z0-9]+", "length({m}) >= 20"),
        ("hex", "[0-9a-f]+", "length({m}) >= 24"),
        ("github", "gh[pousr]_[A-Za-z0-9]+", "length({m}) >= 40"),
        ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length({m}) >= 30"),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    ],
)

ORACLES["op4_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), win AS (
  SELECT doc, i, hash(array_to_string(ws[i+1:i+35], ' ')) AS h, md5(array_to_string(ws[i+1:i+35], ' ')) AS m
  FROM (SELECT doc, ws, unnest(range(0, len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35)
), rep AS (
  SELECT doc, i FROM win WHERE (h, m) IN (SELECT (h, m) FROM win GROUP BY h, m HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc, i + k AS w FROM rep, range(0, 35) t(k)
), each AS (
  SELECT doc, generate_subscripts(ws, 1) - 1 AS w, unnest(ws) AS word FROM d
), kept AS (
  SELECT e.doc, count(*) AS n, string_agg(word, ' ' ORDER BY e.w) AS told
  FROM each e ANTI JOIN gone g ON e.doc = g.doc AND e.w = g.w GROUP BY e.doc
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.told, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc = k.doc
"""

_BYTE = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_LUHN = """len(regexp_replace({m}, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform(
  list_reverse(string_split_regex(regexp_replace({m}, '[^0-9]', '', 'g'), '')),
  lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"""
BASE_PERSONAL = _digest(
    ["email", "ip", "card", "phone"],
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "regexp_full_match({m}, '" + _BYTE.replace("{", "{{").replace("}", "}}") + r"(\." + _BYTE.replace("{", "{{").replace("}", "}}") + "){{3}}')"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(regexp_replace({m}, '[^0-9]', '', 'g')) BETWEEN 10 AND 15"),
    ],
)


def _licenses() -> str:
    from .licenses import PHRASES, TEMPLATES, THRESHOLD, WIDTH

    quote = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{name}', {quote(sorted(set(text.split())))})" for name, text in TEMPLATES)
    phrases = ", ".join(f"('{label}', {quote(phrase.split())})" for phrase, label in PHRASES)
    half = WIDTH // 2
    return f"""WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents
), p(label, ps) AS (VALUES {phrases}), t(label, ts) AS (VALUES {templates}),
places AS (SELECT doc, label, unnest(list_filter(range(0, greatest(0, len(ws) - len(ps) + 1)), lambda i: ws[i+1:i+len(ps)] = ps)) AS place FROM d, p),
base AS (SELECT doc, count(*) AS n, min(place) AS lo, max(place) AS hi, list_distinct(list(label)) AS labels FROM places GROUP BY doc),
blocks AS (SELECT doc, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= {WIDTH} THEN [0] ELSE list_distinct(list_append(range(0, len(ws) - {WIDTH} + 1, {half}), len(ws) - {WIDTH})) END) AS s FROM d),
hits AS (SELECT doc, label, max(share) AS share FROM (SELECT doc, label, len(list_intersect(list_distinct(ws[s+1:s+{WIDTH}]), ts)) / len(ts)::DOUBLE AS share, len(list_intersect(list_distinct(ws[s+1:s+{WIDTH}]), ts)) >= ceil({THRESHOLD} * len(ts) - 1e-9) AS ok FROM blocks, t) WHERE ok GROUP BY 1, 2),
own AS (SELECT doc, list(label) AS labels, max(share) AS share FROM hits GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(own.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc) LEFT JOIN own USING (doc)"""


ORACLES["op7_license_scan"] = _licenses()


ORACLES["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS fails
  FROM d LEFT JOIN marks USING (doc_id)
), l(k, letter) AS (
  VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), sets AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), each AS (
  SELECT part, filter_order, s.step, o[s.step] AS own, fails[o[s.step]] AS here, n, good, toxic,
         len(list_filter(o[1:s.step-1], lambda k: fails[k])) > 0 AS before, len(list_filter(fails, lambda x: x)) AS many
  FROM sets, orders, range(1, 6) s(step)
), told AS (
  SELECT part, filter_order, step::INTEGER AS step, any_value(own) AS own,
         coalesce(sum(n) FILTER (WHERE NOT before AND NOT here), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT before AND here), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE before AND here), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE here AND many = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE NOT before AND here AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (WHERE NOT before AND here AND toxic), 0)::BIGINT AS toxic_lost
  FROM each GROUP BY part, filter_order, step
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM told
"""


def _clusters(k: int = 16, rounds: int = 3) -> str:
    """Rounds of assignment and moving, one after the other; distances in integers."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT row, vec_id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance
  FROM (SELECT row, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::BIGINT AS d FROM kept, c{r})
  GROUP BY row, vec_id, v
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (
  SELECT c, coalesce(m, w) AS w FROM c{r} LEFT JOIN (
    SELECT cluster, list(mean ORDER BY i) AS m FROM (
      SELECT cluster, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS mean FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i
    ) GROUP BY cluster
  ) ON cluster = c
)""")
    return f"""WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v))::INTEGER - 1 AS c, v AS w FROM kept ORDER BY sha256('1:' || vec_id), v LIMIT {k}
), {", ".join(steps)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = c"""


ORACLES["op12_centroid_clusters"] = _clusters()

ORACLES["op13_suffix_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), part AS (  -- pieces of a thousand places, so that no long text is cut from its beginning again and again
  SELECT doc, base, substring(x, (2 * base + 1)::BIGINT, 2398) AS piece FROM (SELECT doc, x, unnest(range(0, length(x) // 2 - 199, 1000)) AS base FROM d WHERE length(x) >= 400)
), win AS (
  SELECT doc, base + i AS i, md5(substring(piece, (2 * i + 1)::BIGINT, 400)) AS m FROM (SELECT doc, base, piece, unnest(range(0, least(1000, length(piece) // 2 - 199))) AS i FROM part)
), rep AS (
  SELECT doc, i FROM win WHERE m IN (SELECT m FROM win GROUP BY m HAVING count(*) > 1)
), runs AS (
  SELECT doc, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT doc, i, sum(new) OVER (PARTITION BY doc ORDER BY i) AS g
        FROM (SELECT doc, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM rep))
  GROUP BY doc, g
), between_runs AS (
  SELECT doc, a, b, coalesce(lag(b) OVER (PARTITION BY doc ORDER BY a), 0) AS p FROM runs
), told AS (
  SELECT doc, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substring(x, (2 * p + 1)::BIGINT, (2 * (a - p))::BIGINT), '' ORDER BY a) AS head
  FROM between_runs JOIN d USING (doc) GROUP BY doc
)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substring(x, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN told USING (doc)
"""
