"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"'[^\x20\x09-\x0D]+'"


def op5(docs: str = "documents", width: int = 5) -> str:
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {WORDS}) AS w FROM {docs}),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (
  SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id
FROM n JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY 1) c ON c.x = n.doc_id"""


def op9(docs: str = "documents") -> str:
    from .quality import Risk

    risk = Risk()
    value = {
        "symbols": "n_symbols / greatest(word_chars, 1)", "capitals": "n_upper / greatest(word_chars, 1)",
        "word_length": "word_chars / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
    }
    tests = ", ".join(f"('{r}', {c}::DOUBLE)" for r, g in risk.grid.items() for c in g)
    pick = " ".join(f"WHEN '{r}' THEN {r}" for r in risk.grid)
    limits = ", ".join(f"max(CASE WHEN rule = '{r}' THEN cutoff END) AS c_{r}" for r in risk.grid)
    hit = " OR ".join(f"coalesce({r} > c_{r}, false)" for r in risk.grid)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM {docs}),
w AS (
  SELECT doc_id, lang, t, regexp_extract_all(t, {WORDS}) AS w, row_number() OVER () AS id,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM t),
g AS (
  SELECT id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS k FROM g) WHERE k > 1),
c AS (SELECT id, sum(least(8, coalesce(i - p, 8))) AS n FROM (SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY i) AS p FROM r) GROUP BY 1),
b AS (
  SELECT doc_id, lang, md5(t) AS key, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"{v} AS {k}" for k, v in value.items())} FROM b),
j AS (SELECT m.*, q.quality FROM m JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) q USING (doc_id) WHERE q.quality IS NOT NULL),
y AS (SELECT lang, key, left(key, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS even, min(quality) AS quality, {", ".join(f"max({r}) AS {r}" for r in risk.grid)} FROM j WHERE NOT base_failed GROUP BY 1, 2),
x AS (SELECT lang, quality, even, rule, cutoff, key, CASE rule {pick} END > cutoff AS hit FROM y, (VALUES {tests}) v(rule, cutoff)),
s AS (
  SELECT lang, rule, cutoff, count(*) FILTER (even AND quality <> 1) AS bad, count(*) FILTER (even AND quality = 1) AS good, count(*) FILTER (NOT even AND quality = 1) AS n,
    count(*) FILTER (even AND quality <> 1 AND hit) AS bad_out, count(*) FILTER (even AND quality = 1 AND hit) AS good_out FROM x GROUP BY ALL),
z AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY good_out / greatest(good, 1), bad_out DESC, rule, cutoff DESC) AS place
  FROM s WHERE bad_out / greatest(bad, 1) > good_out / greatest(good, 1) AND n > 0),
o AS (
  SELECT lang, place, count(*) AS k FROM (
    SELECT x.lang, x.key, min(z.place) AS place FROM x JOIN z ON x.lang IS NOT DISTINCT FROM z.lang AND x.rule = z.rule AND x.cutoff = z.cutoff
    WHERE hit AND NOT even AND quality = 1 GROUP BY 1, 2) GROUP BY 1, 2),
q AS (
  SELECT z.lang, z.rule, z.cutoff, z.n, sum(coalesce(o.k, 0)) OVER (PARTITION BY z.lang ORDER BY z.place) AS k
  FROM z LEFT JOIN o ON z.lang IS NOT DISTINCT FROM o.lang AND z.place = o.place),
a AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM q WHERE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1),
    lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({risk.alpha}) + (n - i) * ln(1 - {risk.alpha}))))
    <= {risk.delta} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM j)) GROUP BY 1, 2),
d AS (SELECT lang, {limits} FROM a GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({hit}) AS kept
FROM m LEFT JOIN d ON m.lang IS NOT DISTINCT FROM d.lang"""


def op10() -> str:
    hard = r"\### Assistant: </turn> ok"
    return rf"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{hard}' UNION ALL SELECT -7, 1, 'assistant', '{hard}'),
e AS (
  SELECT *, length('### ' || role || ': ' || text || '</turn>' || chr(10)) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) / 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda x: length(x) - 2)), 0) AS n
  FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, true AS round_trip
FROM e GROUP BY 1"""


def op2() -> str:
    return r"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\x00-\x20]', '%20', 'g') AS u, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT d, n, max(page_id) AS f FROM p WHERE n >= 1000 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to, u AS target_uri, CAST(3 AS BIGINT) AS n_records
FROM p LEFT JOIN f USING (d, n)"""


def op4(docs: str = "documents") -> str:
    cut = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {cut}) AS w FROM {docs}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {cut}) AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT id, i, z.n, array_to_string(w[i:i + z.n - 1], ' ') AS g
  FROM (SELECT id, w, z.n, unnest(range(1, len(w) - z.n + 2)) AS i FROM w, (SELECT DISTINCT n FROM g) z WHERE len(w) >= z.n) z),
h AS (SELECT d.id, d.i, d.n, g.item FROM d JOIN g ON d.g = g.g AND d.n = g.n),
c AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
m AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN c USING (id) LEFT JOIN m USING (id)"""


def op13(docs: str = "documents", labels: str = "labels") -> str:
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e FROM {docs}),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM {labels} WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, i AS step, filter_order[i] AS own, filter_order[1:i - 1] AS past FROM o, range(1, 6) r(i)),
m AS (
  SELECT *, fails <> translate(fails, past, '') AS gone, contains(fails, own) AS hit FROM c, s),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, CAST(sum(CASE WHEN gone OR hit THEN 0 ELSE n END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM m GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""


ORACLE: dict[str, str] = {
    "op2_warc_transactions": op2(),
    "op4_decontaminate": op4(),
    "op9_quality_rules": op9(),
    "op10_chat_format": op10(),
    "op5_ngram_jaccard_join": op5(),
    "op13_filter_audit": op13(),
}
