"""DuckDB SQL of the registered queries, where SQL can express them on whole tables.

Each states the contract by itself: no pattern, threshold or list is taken from the operators.
"""

_WORD = r"[^\x20\x09-\x0D]+"

_QUALITY = rf"""
WITH texts AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT rn, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM texts
),
windows AS (
  SELECT rn, unnest(range(1, len(w) - 6)) AS place,
    unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS window8
  FROM cut WHERE len(w) >= 8
),
twice AS (SELECT rn, place FROM windows QUALIFY count(*) OVER (PARTITION BY rn, window8) > 1),
covered AS (SELECT rn, count(DISTINCT place + k) AS n FROM twice, range(0, 8) r(k) GROUP BY rn),
measured AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(t) - length(replace(t, '!', '')) AS n_exclamations,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_adjacent
  FROM cut LEFT JOIN covered USING (rn)
),
judged AS (
  SELECT *, (
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_exclamations > 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_upper > 4 * word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END + CASE WHEN 10 * n_adjacent > 3 * n_words THEN 128 ELSE 0 END
    + CASE WHEN n_lines >= 10 AND 10 * n_dup_lines > 5 * n_lines THEN 256 ELSE 0 END)::BIGINT AS failures
  FROM measured
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures
FROM judged
"""

_NEAR = rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rn, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents
),
sets AS (
  SELECT rn, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM texts
),
shingles AS (SELECT rn, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.rn AS a, b.rn AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.rn <> b.rn
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rn, b.rn
),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (n_a + n_b - common)),
reach AS (
  SELECT rn AS a, rn AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
),
classes AS (SELECT r.a AS rn, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.rn = r.b GROUP BY r.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM sets JOIN classes USING (rn)
"""

ORACLES: dict[str, str] = {"op3_quality_rules": _QUALITY, "op11_minhash_forest": _NEAR}
