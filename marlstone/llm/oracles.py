"""DuckDB SQL that states what the SQL-expressible queries of this subpackage return, over whole tables."""

from marlstone.llm.quality_rules import INSULTS

_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STRIPPED = r"regexp_replace({0}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
_LOWER = "lower({0})"

OP1 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
m AS (
  SELECT doc_id, t, w, len(w) AS n, length(array_to_string(w, '')) AS chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM m, unnest(range(1, n - 1)) AS u(i)),
again AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN again USING (doc_id, g)) GROUP BY doc_id),
b AS (
  SELECT m.*, len(lines) - len(list_distinct(lines)) AS dups, coalesce(c, 0) AS rep,
    n < 50 OR 100 * coalesce(c, 0) > 50 * n AS failed FROM m LEFT JOIN covered USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
  rep::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT (failed OR chars < 2 * n OR chars > 14 * n OR 100 * symbols > 15 * n OR 100 * dups > 30 * len(string_split(t, chr(10)))
    OR 100 * len(list_filter(w, lambda x: x <> lower(x) AND x = upper(x))) > 30 * n
    OR 100 * (length(t) - length(replace(t, '!', ''))) > 30 * n
    OR (insults >= 2 AND 200 * insults > n)) AS kept
FROM (SELECT *, len(regexp_extract_all(t, '(?i)\b({"|".join(INSULTS)})\b')) AS insults FROM b)
"""

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, {_STRIPPED.format("line")} AS key FROM l),
total AS (SELECT source, count(*) AS total FROM d GROUP BY source),
held AS (SELECT source, key, count(DISTINCT r) AS pages FROM k WHERE key <> '' GROUP BY source, key HAVING count(DISTINCT r) >= 2),
over AS (SELECT held.source, key FROM held JOIN total ON held.source IS NOT DISTINCT FROM total.source WHERE pages > 0.1 * total),
p AS (
  SELECT k.r, (count(*) FILTER (WHERE k.key <> ''))::BIGINT AS n_lines, count(o.key)::BIGINT AS n_removed,
    coalesce(string_agg(CASE WHEN o.key IS NULL THEN line END, chr(10) ORDER BY pos), '') AS clean_text
  FROM k LEFT JOIN over AS o ON k.source IS NOT DISTINCT FROM o.source AND k.key = o.key GROUP BY k.r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, clean_text FROM d LEFT JOIN p USING (r)
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, w, len(w) AS size, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT q, size, k, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS g FROM b, unnest(range(1, size - k + 2)) AS u(i)),
ds AS (SELECT r, k, len(w) - k + 1 AS n, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM b) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i)),
starts AS (SELECT DISTINCT r, q, size - k + 1 AS m, ds.k, n, unnest(range(greatest(0, ds.pos - (size - k)), ds.pos + 1)) AS start FROM ds JOIN bs USING (k, g)),
a AS (SELECT s.*, ds.g, count(*) AS c FROM starts AS s JOIN ds ON s.r = ds.r AND s.k = ds.k AND ds.pos BETWEEN start AND start + m - 1 GROUP BY ALL),
e AS (SELECT q, g, count(*) AS c FROM bs GROUP BY ALL),
s AS (SELECT r, q, start, any_value(n) AS n, any_value(m) AS m, sum(least(a.c, e.c)) AS shared FROM a JOIN e USING (q, g) GROUP BY ALL),
x AS (SELECT doc_id, item_id, max(shared / (least(m, n - start) + m - shared)) AS similarity FROM s JOIN d USING (r) JOIN b USING (q) GROUP BY ALL)
SELECT doc_id, item_id, round(similarity, 6) AS similarity FROM x WHERE similarity >= 0.8
"""

_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS[0]}', '{_LETTERS[1]}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*)::BIGINT AS total, sum(len(t))::BIGINT AS size FROM d WHERE len(t) > 0),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s WHERE term IN (SELECT term FROM q) GROUP BY term, total),
m AS (SELECT r, doc_id, 75 + (25 * len(t)::BIGINT * total) // size AS m FROM d, s WHERE len(t) > 0),
x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r),
y AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM y WHERE rank <= 20
"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
again AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM g JOIN again USING (g), unnest(range(0, 35)) AS v(k)),
left_ AS (
  SELECT p.r, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) AS p LEFT JOIN gone ON p.r = gone.r AND p.p = gone.p WHERE gone.p IS NULL GROUP BY p.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ USING (r)
"""

OP13 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
