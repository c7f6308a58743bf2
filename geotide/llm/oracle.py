"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

from geotide.llm import licenses, mixing, secrets

#: Explicit cut of a text into words: only ASCII white space separates.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _exact_dedup() -> str:
    return r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY s)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.s AS text_sha256 FROM n JOIN g ON n.s = g.s"""


def _substring() -> str:
    return rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, w[s + 1:s + 20] AS win, s FROM d, range(greatest(len(w) - 19, 0)) r(s)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(win, ' ') ORDER BY doc_id, s) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM f, range(20) r(k) WHERE nth > 1),
word AS (SELECT doc_id, i, w[i + 1] AS word FROM d, range(len(w)) r(i)),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS t, count(*) AS n
         FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


def _secrets() -> str:
    """Each match is located by the lengths of the pieces before it, found by cutting at the matches."""
    parts = []
    for k, r in enumerate(secrets.ALL_RULES):
        pattern = r.pattern.replace("'", "''")
        size = f"length(regexp_extract(m[i], '{pattern}', {r.group}))" if r.group else "length(m[i])"
        parts.append(f"""
SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {size} AS size, {r.least} AS least, length(m[i]) AS len,
       list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g
      FROM d WHERE regexp_matches(text, '{pattern}')), range(1, len(m) + 1) r(i)""")
    base = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
o AS (SELECT doc_id, k, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + len AS BIGINT) AS t FROM f WHERE size >= least),
p AS (SELECT doc_id, {counts}, string_agg(t, ',' ORDER BY a, k) FILTER (k < {base}) AS b, string_agg(t, ',' ORDER BY a, k) AS s
      FROM o GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)},
       sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN p ON d.doc_id = p.doc_id"""


def _licenses() -> str:
    phrases = ", ".join(f"('{p}', '{x}', {len(p.split())})" for p, x in licenses.BASE_PHRASES)
    rows = ", ".join(f"({k}, '{x}', '{s}')" for k, (x, s) in enumerate(licenses.TEMPLATES))
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, {word}) AS w FROM low),
ph(p, x, n) AS (VALUES {phrases}),
hit AS (SELECT doc_id, i, x FROM w, ph, range(greatest(len(w) - n + 1, 0)) r(i) WHERE array_to_string(w[i + 1:i + n], ' ') = p),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b FROM hit GROUP BY doc_id),
tp AS (SELECT k, x, list_distinct(string_split(s, ' ')) AS s FROM (VALUES {rows}) v(k, x, s)),
line AS (SELECT doc_id, list_distinct(regexp_extract_all(l, {word})) AS s FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM low)),
sim AS (SELECT doc_id, x, len(list_intersect(line.s, tp.s)) / len(tp.s) AS c FROM line, tp
        WHERE len(list_intersect(line.s, tp.s)) >= ceil(len(tp.s) * {licenses.CONTAINMENT} - 1e-9)),
best AS (SELECT doc_id, max(c) AS c FROM sim GROUP BY doc_id),
lab AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, x FROM hit) GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT doc_id, x FROM hit UNION SELECT doc_id, x FROM sim) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.b AS last_word,
       coalesce(lab.t, '') AS base_labels, coalesce(every.t, '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.c, 0.0) END AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN lab ON w.doc_id = lab.doc_id
LEFT JOIN every ON w.doc_id = every.doc_id LEFT JOIN best ON w.doc_id = best.doc_id"""


def _mixing() -> str:
    return f"""
WITH per AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1)) AS size FROM documents GROUP BY source),
rate AS (SELECT source, pow(size::DOUBLE, {mixing.TEMPERATURE}) / (SELECT sum(pow(size::DOUBLE, {mixing.TEMPERATURE})) FROM per)
                * (SELECT sum(size) FROM per) / size AS m FROM per),
term AS (SELECT source, k, exp(k * ln(m) - m - lgamma(k + 1)) AS p
         FROM rate, range(0, 400) r(k) WHERE k <= m + 12 * sqrt(m) + 30),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM term),
u AS (SELECT doc_id, source, ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT doc_id, u.source, count(*) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY doc_id, u.source)
SELECT doc_id, source, copy, n AS n_copies, substr(md5('{mixing.SEED}:' || doc_id || ':' || copy), 1, 16) AS shuffle_key
FROM n, range(1, n + 1) r(copy)"""


def _top_k() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
      FROM v q, v d WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


#: Lower-cased terms of a text, as the lexical search cuts them.
_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


def _lexical() -> str:
    return f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
tot AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term),
it AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
m AS (SELECT doc_id, 100 - 50 + (50 * len(t) * n_docs) // n_terms AS m FROM d, tot WHERE len(t) > 0),
s AS (SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM it JOIN tf ON it.term = tf.term JOIN w ON w.term = tf.term JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""


def _collocations() -> str:
    """Counts of all phrases, then the definition; 128-bit products."""
    return r"""
WITH piece AS (SELECT row_number() OVER () AS p, lang, w FROM (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[.,;:!?\x0A-\x0D]')) AS x FROM documents))),
g AS (SELECT lang, w[s:s + k - 1] AS g, count(*) AS f FROM piece, range(1, 6) a(k), range(1, len(w) - k + 2) b(s) GROUP BY lang, w[s:s + k - 1]),
tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
o AS (SELECT lang, g, f FROM g WHERE f >= 100),
cut AS (SELECT o.lang, o.g, o.f AS a, k, x.f AS l, y.f AS r, n,
               (1000::HUGEINT * o.f * n) // (x.f::HUGEINT * y.f) AS score
        FROM o JOIN tot ON o.lang = tot.lang, range(1, len(o.g)) c(k)
        JOIN o x ON x.lang = o.lang AND x.g = o.g[1:k] JOIN o y ON y.lang = o.lang AND y.g = o.g[k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_of AS (SELECT DISTINCT lang, g[1:len(g) - 1] AS g, f FROM o WHERE len(g) > 2 UNION SELECT DISTINCT lang, g[2:] AS g, f FROM o WHERE len(g) > 2),
kept AS (SELECT * FROM best ANTI JOIN inner_of ON best.lang = inner_of.lang AND best.g = inner_of.g AND best.a = inner_of.f),
r AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM r) WHERE rank <= 2000"""


ORACLE: dict[str, str] = {
    "op2_substring_dedup": _substring(),
    "op3_secret_scan": _secrets(),
    "op4_exact_dedup": _exact_dedup(),
    "op6_license_scan": _licenses(),
    "op8_source_mixing": _mixing(),
    "op11_exact_topk": _top_k(),
    "op12_lexical_search": _lexical(),
    "op13_collocations": _collocations(),
}
