"""SQL with the same results as the registered queries, for the correctness check."""

from __future__ import annotations

from corpusq.operators.answers import INSTRUCTION_PROMPT, ROLE_PROMPT
from corpusq.plans.tables import LEFT_OUT, SITE
from corpusq.plans.queries import TOPIC


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _prompt(template: str, context: str, question: str) -> str:
    pieces = template.replace("{topic}", TOPIC).replace("{context}", "\0context\0").replace("{question}", "\0question\0")
    values = {"context": context, "question": question}
    return " || ".join(values.get(p, _text(p)) for p in pieces.split("\0"))


_WS = "[ \\t\\n\\r\\f]+"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'), ' ')"


def _count(x: str) -> str:
    return f"len(list_filter(string_split({_clean(x)}, ' '), lambda w: w <> ''))"


def _drop_numeric(x: str) -> str:
    parts = f"list_filter(string_split({_clean('line')}, ' '), lambda w: w <> '')"
    return (
        f"array_to_string(list_filter(string_split({x}, chr(10)), lambda line: NOT ("
        f"len(list_filter({parts}, lambda w: regexp_matches(w, '\\p{{Nd}}'))) > 0.4 * len({parts}) "
        f"AND NOT ends_with(rtrim(line), '.'))), chr(10))"
    )


def _sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))"


def _groups(sents: str, n: int) -> str:
    return (
        f"list_transform(range(1, len({sents}) + 1, {n}), "
        f"lambda i: array_to_string({sents}[i:i + {n - 1}], ' '))"
    )


_CHUNKS = f"""
doc_cut AS (
  SELECT doc_id, text, source, lang, {_count('text')} AS whole,
         {_sentences(_clean(_drop_numeric('text')))} AS sents
  FROM documents
),
doc_parts AS (
  SELECT doc_id, source, lang,
         CASE WHEN whole <= 512 THEN [text]
              WHEN array_to_string(sents, ' ') = '' THEN []
              ELSE {_groups('sents', 6)} END AS parts
  FROM doc_cut
),
chunks AS (
  SELECT doc_id, source || ' ' || lang AS title, '{SITE}Order_' || doc_id AS page_url,
         unnest(range(len(parts))) AS split_id, unnest(parts) AS split
  FROM doc_parts
),
counted AS (SELECT *, {_count('split')} AS tokens FROM chunks)
"""


def _vector(rows: str, keys: str, text: str) -> str:
    """Hashed word vectors `(keys, embedding FLOAT[])` of a relation."""
    return f"""
    SELECT {keys}, CASE WHEN size > 0 THEN list_transform(counts, lambda c: (c / size)::FLOAT)
                   ELSE list_transform(counts, lambda c: 0::FLOAT) END AS embedding
    FROM (
      SELECT *, sqrt(list_sum(list_transform(counts, lambda c: c * c))) AS size FROM (
        SELECT {keys}, list_transform(range(64), lambda d: len(list_filter(buckets, lambda b: b = d))::DOUBLE) AS counts
        FROM (
          SELECT {keys}, list_transform(
            list_filter(string_split({_clean(f'lower({text})')}, ' '), lambda w: w <> ''),
            lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS buckets
          FROM {rows}))) AS v"""


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"

_HITS = f"""
WITH {_CHUNKS},
qv AS ({_vector('benchmark', 'item_id', 'text')}),
cv AS ({_vector('chunks', 'doc_id, split_id', 'split')}),
scored AS (
  SELECT a.item_id, b.doc_id, b.split_id, round({_COS}, 9) AS score
  FROM qv a, cv b
  WHERE list_sum(a.embedding) > 0 AND list_sum(b.embedding) > 0
),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, split_id) AS rank FROM scored
  QUALIFY rank <= 2
),
found AS (
  SELECT item_id AS question_id,
         list(c.split ORDER BY rank) AS splits, list(c.page_url ORDER BY rank) AS urls,
         list(c.title ORDER BY rank) AS titles
  FROM hits JOIN chunks c USING (doc_id, split_id) GROUP BY item_id
),
asked AS (
  SELECT item_id AS question_id, text AS question, splits, coalesce(urls, []) AS urls, coalesce(titles, []) AS titles
  FROM benchmark LEFT JOIN found ON item_id = question_id
)
"""


def _top(metric: str, shown: str, order: str, rank: str) -> str:
    return f"""
WITH s AS (
  SELECT a.vec_id AS question_id, b.vec_id AS id, round({metric}, 9) AS score
  FROM embeddings a, embeddings b
),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score {order}, id) AS rank FROM s)
SELECT question_id, {shown} AS rank, id, round(score, 6) AS score FROM r WHERE {rank}
"""


_TOP2 = _top(_COS, "rank", "DESC", "rank <= 2")

# Cells whose centroids are the first sixteen vectors: each vector's cells in the order of nearness.
_CELLS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (
  SELECT v.vec_id, c.vec_id AS cell,
    row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_cosine_similarity(v.e, c.e), 9) DESC, c.vec_id) AS place
  FROM v, v c WHERE c.vec_id < 16
),
scored AS (
  SELECT a.vec_id AS question_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b
),
exact AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 2
)
"""


def _probed(n_probe: int) -> str:
    return f"""
probed AS (
  SELECT s.*, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank
  FROM scored s JOIN near p ON p.vec_id = s.question_id AND p.place <= {n_probe}
  JOIN near h ON h.vec_id = s.id AND h.place = 1 AND h.cell = p.cell
  QUALIFY rank <= 2
)
"""


_NEXT = """
WITH pairs AS (
  SELECT x.vec_id AS id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b
  FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1
)
"""


# --- sections ---------------------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sections(pages: str, carried: str, excluded: tuple[str, ...]) -> str:
    """CTEs that parse `pages(carried, content)`; the last one is `parsed`."""
    out = ", ".join(_text(x) for x in excluded)
    keep = f"coalesce(section NOT IN ({out}), true)" if excluded else "true"
    return f"""
src AS ({pages}),
raw_lines AS (
  SELECT page_id, unnest(range(len(ls))) AS pos, unnest(ls) AS raw
  FROM (SELECT page_id, string_split(content, chr(10)) AS ls FROM src)
),
stripped AS (SELECT page_id, pos, {_strip('raw')} AS line FROM raw_lines WHERE raw <> ''),
marked AS (
  SELECT *, CASE WHEN starts_with(line, '=== ') AND ends_with(line, ' ===') THEN 2
                 WHEN starts_with(line, '== ') AND ends_with(line, ' ==') THEN 1 ELSE 0 END AS level
  FROM stripped
),
placed AS (
  SELECT page_id, pos, line, level,
    last_value(CASE WHEN level = 1 THEN trim(line, '=') END IGNORE NULLS) OVER w AS section,
    last_value(CASE WHEN level = 2 THEN trim(line, '=') END IGNORE NULLS) OVER w AS subsection
  FROM marked
  WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
bodies AS (SELECT * FROM placed WHERE level = 0 AND {keep}),
breaks AS (
  SELECT *, CASE WHEN row_number() OVER w = 1
      OR section IS DISTINCT FROM lag(section) OVER w
      OR subsection IS DISTINCT FROM lag(subsection) OVER w THEN 1 ELSE 0 END AS brk
  FROM bodies WINDOW w AS (PARTITION BY page_id ORDER BY pos)
),
islands AS (
  SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY pos) - 1 AS section_no FROM breaks
),
parsed AS (
  SELECT page_id, {carried}, section_no::INT AS section_no, section, subsection, content FROM (
    SELECT page_id, section_no, any_value(section) AS section, any_value(subsection) AS subsection,
           string_agg(line, ' ' ORDER BY pos) AS content
    FROM islands GROUP BY page_id, section_no
  ) JOIN (SELECT * EXCLUDE (content) FROM src) USING (page_id)
)
"""


_MARKUP = """
SELECT doc_id AS page_id, source || ' ' || lang AS title,
       regexp_replace(regexp_replace(text, '(?m)^(\\S+)$', '== \\1 ==', 'g'),
                      '(?m)^(\\S+ \\S+)$', '=== \\1 ===', 'g') AS content
FROM documents
"""

_WEB = """
SELECT page_id, url,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<h1>([^<]*)</h1>', chr(10) || '== \\1 ==' || chr(10), 'g'),
    '<li><a[^>]*>([^<]*)</a></li>', chr(10) || '=== \\1 ===' || chr(10), 'g'),
    '</?p>|<br>', chr(10), 'g'),
    '<[^>]*>', '', 'g') AS content
FROM pages
"""

# --- graph ------------------------------------------------------------------

_GRAPH = f"""
concept AS (
  SELECT 'Category:' || r_name AS id FROM region UNION ALL SELECT 'Category:' || n_name FROM nation
  UNION ALL SELECT 'Category:' || c_name FROM customer UNION ALL SELECT 'Category:' || s_name FROM supplier
  UNION ALL SELECT 'Category:Part ' || p_partkey FROM part
),
label AS (
  SELECT 'Category:' || r_name AS id, r_name AS label FROM region
  UNION ALL SELECT 'Category:' || n_name, n_name FROM nation
  UNION ALL SELECT 'Category:' || n_name, n_name || ' nation' FROM nation
  UNION ALL SELECT 'Category:' || c_name, c_name || ' ' || lower(c_mktsegment) FROM customer
  UNION ALL SELECT 'Category:' || s_name, s_name || ' ' || p_name FROM supplier JOIN part ON s_suppkey = p_partkey
  UNION ALL SELECT 'Category:Part ' || p_partkey, p_name FROM part
),
broader AS (
  SELECT 'Category:' || n_name AS child, 'Category:' || r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Category:' || c_name, 'Category:' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Category:' || s_name, 'Category:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'Category:Part ' || l_partkey, 'Category:' || s_name
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey
),
subject AS (
  SELECT o_orderkey AS page, 'Category:' || c_name AS category FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT DISTINCT l_orderkey, 'Category:Part ' || l_partkey FROM lineitem
),
page AS (SELECT o_orderkey AS page_id, '{SITE}Order_' || o_orderkey AS page_url FROM orders)
"""

_PART_WORDS = """
part_words AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part),
word_counts AS (SELECT word, count(*) AS n FROM part_words GROUP BY word),
stop AS (SELECT word FROM word_counts WHERE n < (SELECT avg(n) FROM word_counts)),
clean_label AS (SELECT * FROM label WHERE NOT EXISTS (SELECT 1 FROM stop WHERE contains(label.label, stop.word)))
"""


def _reached(depth: int, edges: str) -> str:
    """Categories below the roots with their first level."""
    return f"""
edges AS ({edges}),
walk AS (
  SELECT -1 AS level, 'Category:' || r_name AS category FROM region
  UNION
  SELECT level + 1, child FROM walk JOIN edges ON parent = category WHERE level + 1 < {depth}
),
reached AS (
  SELECT min(level) AS level, category FROM walk GROUP BY category HAVING min(level) >= 0
)
"""


_CLEAN_EDGES = "SELECT DISTINCT parent, child FROM broader WHERE child IN (SELECT id FROM clean_label)"
_ALL_EDGES = "SELECT DISTINCT parent, child FROM broader WHERE child IN (SELECT id FROM label)"

_BOUNDS = (
    "SELECT page_id, min(ts) AS creation_date, max(ts) AS last_modified FROM ("
    "SELECT o_orderkey AS page_id, o_orderdate AS ts FROM orders UNION ALL SELECT l_orderkey, l_shipdate FROM lineitem) GROUP BY page_id"
)

_TURNS = """
turns AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)
"""

_TALK = f"""
WITH talk AS ({_vector('conversations', 'conv_id, turn, role', 'text')}),
cosines AS (
  SELECT q.conv_id, q.turn,
    list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS manhattan_distance,
    list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine_similarity,
    list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cosine_similarity_question_a,
    list_cosine_similarity(b.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cosine_similarity_question_b
  FROM talk q JOIN talk a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  JOIN talk b ON b.conv_id = q.conv_id AND b.turn = q.turn + 2
  WHERE q.role = 'user'
)
"""


def _histogram(rows: str, bins: str, by: str = "") -> str:
    """Equal-width histogram of `rows(by, v)`."""
    group = f"{by}, " if by else ""
    return f"""
vals AS ({rows}),
edge AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, {bins} AS bins FROM vals),
binned AS (
  SELECT {group} least(floor((v - lo) / ((hi - lo) / bins))::INT + 1, bins) AS bin, lo, hi, bins FROM vals, edge
)
SELECT {group} bin, round(any_value(lo + (bin - 1) * ((hi - lo) / bins)), 6) AS low,
       round(any_value(lo + bin * ((hi - lo) / bins)), 6) AS high, count(*) AS n
FROM binned GROUP BY {group} bin
"""


_AUTO_BINS = (
    "greatest(ceil((max(v) - min(v)) / least((max(v) - min(v)) / (log2(count(*)) + 1), "
    "2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / power(count(*), 1.0 / 3.0))), 1)::INT"
)

_SIZES = f"""
doc_cut AS (
  SELECT doc_id, {_sentences(_clean(_drop_numeric('text')))} AS sents FROM documents
),
sized AS (SELECT doc_id, sents, n FROM doc_cut, range(1, 8) t(n)),
pieces AS (
  SELECT n AS split_length,
    unnest(list_transform(range(1, len(sents) + 1, n), lambda i: array_to_string(sents[i:i + n - 1], ' '))) AS split
  FROM sized WHERE array_to_string(sents, ' ') <> ''
)
"""

_WORD_GROUPS = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, {_sentences(_clean(_drop_numeric('text')))} AS sents FROM documents
),
sent AS (
  SELECT doc_id, unnest(range(1, len(sents) + 1)) AS pos, unnest(sents) AS s FROM cut
  WHERE array_to_string(sents, ' ') <> ''
),
sized AS (SELECT *, {_count('s')} AS n FROM sent),
walk AS (
  SELECT doc_id, pos, 0 AS split_id, n AS held FROM sized WHERE pos = 1
  UNION ALL
  SELECT z.doc_id, z.pos, CASE WHEN held + n > 100 THEN split_id + 1 ELSE split_id END,
         CASE WHEN held + n > 100 THEN n ELSE held + n END
  FROM walk w JOIN sized z ON z.doc_id = w.doc_id AND z.pos = w.pos + 1
)
SELECT doc_id, split_id, string_agg(s, ' ' ORDER BY pos) AS split, sum(n)::INT AS tokens
FROM walk JOIN sized USING (doc_id, pos) GROUP BY doc_id, split_id
"""

_SHOWN = """
SELECT conv_id, turn,
  replace(('"' || replace(replace(replace(body, '\\', '\\\\'), '\\\\u00', '\\u00'), '"', '\\"') || '"')::JSON ->> '$',
          '\\n', '<br>') AS shown
FROM (
  SELECT conv_id, turn,
    replace(replace(replace(replace(replace(text, chr(10), '\\n'), 'é', '\\u00e9'), 'ç', '\\u00e7'), 'ß', '\\u00df'), 'ñ', '\\u00f1')
      || ' said "so" \\t' AS body
  FROM conversations
)
"""

_OPENERS = (
    "what who whom whose which when where why how is are was were do does did can could will would should"
)
_QUESTION = (
    "CASE WHEN ends_with({c}, '?') OR regexp_extract(lower({c}), '^([a-z]+)', 1) IN ({words}) "
    "THEN 'question' ELSE 'statement' END"
)


def _class(x: str) -> str:
    return _QUESTION.format(c=_clean(x), words=", ".join(_text(w) for w in _OPENERS.split()))


def _record(answer: str) -> str:
    return f"to_json({{'answer': {answer}, 'urls': urls, 'titles': titles}})::VARCHAR"


_MARKUP_CHUNKS = f"""
WITH {_sections(_MARKUP, 'title', LEFT_OUT)},
cut AS (
  SELECT *, {_count('content')} AS whole, {_sentences(_clean(_drop_numeric('content')))} AS sents FROM parsed
),
parts AS (
  SELECT *, CASE WHEN whole <= 512 THEN [content] WHEN array_to_string(sents, ' ') = '' THEN []
                 ELSE {_groups('sents', 6)} END AS parts FROM cut
),
rows AS (SELECT page_id, section_no, section, unnest(range(len(parts))) AS split_id, unnest(parts) AS split FROM parts)
"""

ORACLES = {
    "vector_topk_cells": _CELLS.rstrip() + ", " + _probed(4) + "SELECT question_id, rank, id, round(score, 6) AS score FROM probed",
    "vector_probe_recall": _CELLS.rstrip() + ", " + _probed(12) + """
SELECT count(*) AS expected, count(p.id) AS found, round(count(p.id) / count(*), 6) AS recall
FROM exact e LEFT JOIN probed p USING (question_id, id) WHERE question_id % 50 = 0
""",
    "vector_append_chunks": _MARKUP_CHUNKS + f"""
SELECT page_id, section_no, split_id, section, {_count('split')} AS tokens,
  CASE WHEN page_id % 3 <> 0 THEN 'first' ELSE 'second' END AS batch_id
FROM rows
""",
    "vector_table_lifecycle": """
SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS length, true AS dropped
FROM embeddings
""",
    "json_array_roundtrip": f"WITH {_TURNS} SELECT conv_id, turn, question, reply AS answer FROM turns",
    "text_files": """
SELECT item_id, text || chr(10) AS content, CASE WHEN item_id = (SELECT min(item_id) FROM benchmark) THEN text || chr(10) END AS alone
FROM benchmark
""",
    "rejected_rows": """
SELECT 'text' AS kind, doc_id AS id, CASE doc_id % 10 WHEN 0 THEN 'no text' ELSE 'empty text' END AS reason
FROM documents WHERE doc_id % 10 < 2
UNION ALL
SELECT 'response', event_id, CASE event_id % 10 WHEN 0 THEN 'not a revision response' ELSE 'no revisions for the page' END
FROM events WHERE event_id % 10 < 2
""",
    "row_lookup": """
SELECT doc_id, source, lang FROM documents WHERE doc_id = 7
UNION ALL SELECT doc_id, NULL, lang FROM documents WHERE doc_id = 42
""",
    "metadata_variant": """
SELECT doc_id, source, quality, toxic, NULL::VARCHAR AS absent FROM documents LEFT JOIN labels USING (doc_id)
""",
    "model_hooks": """
SELECT conv_id, turn,
  length(text) || ',' || (length(text) - length(replace(text, 'a', ''))) || ',' || (length(text) - length(replace(text, 'e', ''))) AS embedding,
  (length(text) // 4)::INT AS tokens, CASE WHEN length(text) > 300 THEN 'long' ELSE 'short' END AS label,
  substr(text, 1, 12) || '|7' AS generated
FROM conversations
""",
    "evaluation_best": _HITS + """
SELECT question_id, question, splits[1] AS answer_retreiver, splits[1] AS retreiver_answers12,
  regexp_replace(coalesce(splits[1], ''), '^\\s+', '') AS qasystem_answers
FROM asked
""",
    "concept_search_rare": f"""
WITH {_GRAPH}, {_PART_WORDS},
per_label AS (
  SELECT c.id, l.label, count(*) AS n FROM concept c JOIN clean_label l ON l.id = c.id JOIN broader b ON b.parent = c.id
  WHERE contains(l.label, 'ation') GROUP BY c.id, l.label HAVING count(*) > 2
)
SELECT id, max(n) AS n FROM per_label GROUP BY id
""",
    "empty_term": f"""
WITH {_GRAPH}
SELECT 'given' AS term, count(*) AS n FROM (
  SELECT c.id FROM concept c JOIN label l ON l.id = c.id JOIN broader b ON b.parent = c.id GROUP BY c.id)
UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'null', 0
""",
    "inline_narrower": f"""
WITH {_GRAPH}
SELECT DISTINCT CASE parent WHEN 'Category:NATION_1' THEN 0 ELSE 1 END AS level, parent, child
FROM broader JOIN label ON label.id = child WHERE parent IN ('Category:NATION_1', 'Category:NATION_2')
""",
    "vector_top2": _TOP2,
    "vector_top2_blocks": _TOP2,
    "vector_top2_by_cells": _TOP2,
    "vector_top1_offset": _top(_COS, "rank - 1", "DESC", "rank = 2"),
    "vector_top2_l2": _top(
        "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "rank", "ASC", "rank <= 2"
    ),
    "vector_distances": _NEXT + """
SELECT id, round(list_cosine_similarity(a, b), 6) AS cosine,
  round(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))), 6) AS manhattan,
  round(list_distance(a, b), 6) AS euclid
FROM pairs
""",
    "vector_predicate_scan": """
SELECT vec_id AS id, label, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS length
FROM embeddings WHERE vec_id > 1 ORDER BY vec_id LIMIT 1
""",
    "text_vectors": f"""
WITH v AS ({_vector('benchmark', 'item_id', 'text')})
SELECT item_id AS question_id,
  array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',') AS embedding
FROM v
""",
    "chunk_documents": f"WITH {_CHUNKS} SELECT doc_id, split_id, split, tokens FROM counted",
    "chunk_documents_no_limit": f"""
WITH cut AS (
  SELECT doc_id, {_sentences(_clean(_drop_numeric('text')))} AS sents FROM documents WHERE lang IN ('en', 'fr')
),
parts AS (SELECT doc_id, {_groups('sents', 5)} AS parts FROM cut WHERE array_to_string(sents, ' ') <> ''),
rows AS (SELECT doc_id, unnest(range(len(parts))) AS split_id, unnest(parts) AS split FROM parts)
SELECT doc_id, split_id, split, {_count('split')} AS tokens FROM rows
""",
    "chunk_words": _WORD_GROUPS,
    "numeric_lines": f"""
SELECT doc_id, {_clean(_drop_numeric('t'))} AS cleaned FROM (
  SELECT doc_id, n_chars || ' chars ' || doc_id || chr(10) || text || chr(10) || n_chars || ' chars ' || doc_id || '.' AS t
  FROM documents
)
""",
    "chunk_rows": f"""
WITH {_sections(_MARKUP, 'title', LEFT_OUT)},
numbered AS (SELECT row_number() OVER (ORDER BY page_id, section_no) AS id, * FROM parsed),
cut AS (
  SELECT *, {_count('content')} AS whole, {_sentences(_clean(_drop_numeric('content')))} AS sents FROM numbered
),
parts AS (
  SELECT *, CASE WHEN whole <= 512 THEN [content] WHEN array_to_string(sents, ' ') = '' THEN []
                 ELSE {_groups('sents', 6)} END AS parts FROM cut
),
rows AS (
  SELECT id, page_id, title, section, subsection, unnest(range(len(parts))) AS split_id, unnest(parts) AS split FROM parts
)
SELECT *, {_count('split')} AS tokens FROM rows
""",
    "token_histogram": f"WITH {_CHUNKS}, {_histogram('SELECT tokens AS v FROM counted', _AUTO_BINS)}",
    "chunk_size_histogram": (
        f"WITH {_CHUNKS}, {_SIZES.replace('doc_cut', 'sent_cut')}, "
        + _histogram(
            f"SELECT split_length, {_count('split')} AS v FROM pieces UNION ALL SELECT 0, tokens FROM counted", "20", "split_length"
        )
    ),
    "token_density": f"""
WITH {_CHUNKS},
counts AS (SELECT tokens AS v, count(*) AS n FROM counted GROUP BY tokens)
SELECT point::DOUBLE AS point,
  round(sum(n * exp(-((point - v) / 15.0) * ((point - v) / 15.0) / 2)) / (sum(n) * 15.0 * sqrt(2 * pi())), 9) AS density
FROM counts, range(0, 520, 20) t(point) GROUP BY point
""",
    "token_density_by_rule": f"""
WITH {_CHUNKS},
counts AS (SELECT tokens AS v, count(*) AS n FROM counted GROUP BY tokens),
rule AS (
  SELECT min(tokens) AS lo, max(tokens) AS hi, stddev_samp(tokens) * power(count(*), -0.2) AS h FROM counted
),
grid AS (SELECT lo + (hi - lo) * i / 49.0::DOUBLE AS point, h FROM rule, range(50) t(i))
SELECT round(point, 6) AS point,
  round(sum(n * exp(-((point - v) / h) * ((point - v) / h) / 2)) / (sum(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM counts, grid GROUP BY point
""",
    "sections_from_markup": f"WITH {_sections(_MARKUP, 'title', LEFT_OUT)} SELECT * FROM parsed",
    "sections_from_web_pages": (
        f"WITH {_sections(_WEB, 'url', (' See also ', ' References ', ' External links '))} SELECT * FROM parsed"
    ),
    "revision_bounds": f"""
SELECT page_id, source || ' ' || lang AS title, creation_date, last_modified
FROM documents JOIN ({_BOUNDS}) ON doc_id = page_id
""",
    "revision_json": """
SELECT user_id AS page_id, min(date_trunc('day', ts))::TIMESTAMP AS creation_date,
  max(date_trunc('second', ts)) AS last_modified, count(*) AS responses
FROM events GROUP BY user_id
""",
    "revision_row_bounds": """
SELECT user_id AS page_id, min(date_trunc('day', ts))::TIMESTAMP AS creation_date,
  max(date_trunc('second', ts)) AS last_modified
FROM events GROUP BY user_id
""",
    "graph_store": f"""
WITH {_GRAPH}
SELECT 'terms' AS name, count(*) AS n FROM (SELECT id FROM concept UNION SELECT 'Order_' || page_id FROM page)
UNION ALL SELECT 'concepts', count(*) FROM concept
UNION ALL SELECT 'labels', (SELECT count(*) FROM label) + (SELECT count(*) FROM nation)
UNION ALL SELECT 'broader', count(*) FROM broader UNION ALL SELECT 'subject', count(*) FROM subject
UNION ALL SELECT 'urls', count(*) FROM page UNION ALL SELECT 'page_ids', count(*) FROM page
""",
    "concept_search_id": f"""
WITH {_GRAPH}
SELECT c.id, count(*) AS n FROM concept c JOIN label l ON l.id = c.id JOIN broader b ON b.parent = c.id
WHERE contains(c.id, 'Category:') GROUP BY c.id HAVING count(*) > 5
""",
    "concept_search_label": f"""
WITH {_GRAPH}, {_PART_WORDS},
per_label AS (
  SELECT c.id, l.label, count(*) AS n FROM concept c JOIN clean_label l ON l.id = c.id JOIN broader b ON b.parent = c.id
  WHERE contains(l.label, 'e') GROUP BY c.id, l.label HAVING count(*) > 2
)
SELECT id, max(n) AS n FROM per_label GROUP BY id
""",
    "concept_options": f"""
WITH {_GRAPH}
SELECT '{{"id":"' || id || '","text":"' || id || '"}}' AS record FROM (
  SELECT c.id FROM concept c JOIN label l ON l.id = c.id JOIN broader b ON b.parent = c.id
  GROUP BY c.id HAVING count(*) > 5)
""",
    "stop_word_filter": f"WITH {_GRAPH}, {_PART_WORDS} SELECT id, label FROM clean_label",
    "narrower": f"""
WITH {_GRAPH}, {_PART_WORDS}
SELECT 0 AS level, parent, child, regexp_extract(child, '([^:]*)$', 1) AS name
FROM ({_CLEAN_EDGES}) WHERE parent IN (SELECT 'Category:' || n_name FROM nation)
""",
    "expand": f"""
WITH RECURSIVE {_GRAPH}, {_PART_WORDS}, {_reached(4, _CLEAN_EDGES)}
SELECT level, category, substr(category, 10) AS name FROM reached
""",
    "expand_all_paths": f"""
WITH RECURSIVE {_GRAPH}, edges AS ({_ALL_EDGES}),
walk AS (
  SELECT -1 AS level, 'Category:' || r_name AS category FROM region
  UNION ALL
  SELECT level + 1, child FROM walk JOIN edges ON parent = category WHERE level + 1 < 3
)
SELECT level, category, count(*) AS paths FROM walk WHERE level >= 0 GROUP BY level, category
""",
    "category_pages": f"""
WITH RECURSIVE {_GRAPH}, {_reached(3, _ALL_EDGES)}
SELECT DISTINCT page_url, page_id FROM reached JOIN subject USING (category) JOIN page ON page = page_id
""",
    "category_pages_batched": f"""
WITH {_GRAPH},
batches AS (
  SELECT floor((row_number() OVER (ORDER BY category) - 1) / 50) AS batch_id, category
  FROM (SELECT 'Category:Part ' || p_partkey AS category FROM part)
),
per_batch AS (
  SELECT DISTINCT batch_id, page_url, page_id FROM batches JOIN subject USING (category) JOIN page ON page = page_id
)
SELECT page_url, page_id, count(*) AS batches FROM per_batch GROUP BY page_url, page_id
""",
    "category_batches": """
SELECT floor((row_number() OVER (ORDER BY category) - 1) / 50)::BIGINT AS batch_id, category,
  replace(replace(category, ':', '%3A'), '#', '%23') AS quoted
FROM (SELECT 'Category:' || c_name AS category FROM customer)
""",
    "sparql_bindings": """
SELECT c_custkey, '0' AS level, 'Category:NATION_' || c_nationkey AS r, c_name AS name FROM customer
""",
    "stopword_add_delete": """
SELECT word FROM (
  SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part
  UNION ALL SELECT DISTINCT lower(c_mktsegment) FROM customer
) WHERE word NOT IN (SELECT lower(p_type) FROM part)
""",
    "corpus_build": f"""
WITH RECURSIVE {_GRAPH}, {_reached(3, _ALL_EDGES)},
chosen AS (
  SELECT DISTINCT page_url, page_id FROM reached JOIN subject USING (category) JOIN page ON page = page_id
),
bounds AS ({_BOUNDS}),
{_sections(
    f"SELECT m.page_id, m.title, c.page_url, b.creation_date, b.last_modified, m.content FROM ({_MARKUP}) m "
    "JOIN chosen c USING (page_id) JOIN bounds b USING (page_id)",
    "title, page_url, creation_date, last_modified", LEFT_OUT,
)},
cut AS (
  SELECT *, {_count('content')} AS whole, {_sentences(_clean(_drop_numeric('content')))} AS sents FROM parsed
),
parts AS (
  SELECT *, CASE WHEN whole <= 512 THEN [content] WHEN array_to_string(sents, ' ') = '' THEN []
                 ELSE {_groups('sents', 6)} END AS parts FROM cut
),
rows AS (
  SELECT page_id, section_no, unnest(range(len(parts))) AS split_id, page_url, title, coalesce(section, '') AS section,
    coalesce(subsection, '') AS subsection, unnest(parts) AS split, creation_date, last_modified FROM parts
)
SELECT *, {_count('split')} AS tokens,
  CASE WHEN {_count('split')} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM rows
""",
    "metadata_fill": """
SELECT doc_id, source, lang, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic
FROM documents LEFT JOIN labels USING (doc_id)
""",
    "csv_roundtrip": f"""
WITH {_sections(_MARKUP, 'title', LEFT_OUT)}
SELECT page_id, title, section_no, section, subsection, content FROM parsed
""",
    "json_roundtrip": f"WITH {_TURNS} SELECT conv_id, turn, question, reply AS answer FROM turns",
    "vector_append": """
SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS length
FROM embeddings
""",
    "vector_append_plain": "SELECT vec_id AS id, 2 AS copies FROM embeddings",
    "chunk_top2": _HITS + "SELECT item_id AS question_id, rank, doc_id, split_id, round(score, 6) AS score FROM hits",
    "retrieve_context": _HITS + """
SELECT question_id, question, coalesce(array_to_string(splits, '. '), '') AS context FROM asked
""",
    "retrieve_best": _HITS + "SELECT question_id, splits[1] AS best FROM asked",
    "retrieve_answers": _HITS + f"""
SELECT question_id, {_record("' ' || coalesce(splits[1], '')")} AS record FROM asked
""",
    "retrieve_stored": _HITS + f"""
SELECT question_id, {_record("' ' || coalesce(splits[1], '')")} AS record FROM asked
""",
    "evaluation_run": _HITS + """
SELECT question_id, question, coalesce(array_to_string(splits, '. '), '') AS answer_retreiver,
  coalesce(array_to_string(splits, '. '), '') AS retreiver_answers12,
  regexp_replace(coalesce(splits[1], ''), '^\\s+', '') AS qasystem_answers
FROM asked
""",
    "prompt_build": f"""
WITH {_TURNS}
SELECT conv_id, turn, {_prompt(INSTRUCTION_PROMPT, 'reply', 'question')} AS prompt,
  {_prompt(ROLE_PROMPT, 'reply', 'question')} AS role_prompt
FROM turns
""",
    "answer_extract": f"""
WITH {_TURNS},
raw AS (
  SELECT *, {_prompt(INSTRUCTION_PROMPT, "'none'", 'question')} || chr(10) || ' ' || reply AS one,
    {_prompt(ROLE_PROMPT, "'none'", 'question')} || chr(10) || ' ' || reply AS two
  FROM turns
)
SELECT conv_id, turn, string_split(one, '[/INST]')[2] AS by_mark,
  regexp_extract(one, '(?s)\\[INST\\].*?\\[/INST\\]\\s*(.*)', 1) AS by_pattern,
  NULL::VARCHAR AS no_mark, reply AS no_pattern, string_split(two, 'ASSISTANT:')[2] AS by_role
FROM raw
""",
    "answer_display": _SHOWN,
    "legacy_metadata": """
SELECT doc_id, source || ' nan' AS split, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
""",
    "question_label": f"""
SELECT conv_id, turn, {_class('text')} AS label, {_class("text || ' ?'")} AS asked_label FROM conversations
""",
    "pair_eval": _TALK + """
SELECT conv_id, turn, round(cosine_similarity, 6) AS cosine_similarity, round(manhattan_distance, 6) AS manhattan_distance,
  round(cosine_similarity_question_a, 6) AS cosine_similarity_question_a,
  round(cosine_similarity_question_b, 6) AS cosine_similarity_question_b
FROM cosines
""",
    "score_stats": _TALK + """
SELECT 'cosine_similarity_question_a' AS "column", round(min(cosine_similarity_question_a), 6) AS min,
  round(max(cosine_similarity_question_a), 6) AS max, round(avg(cosine_similarity_question_a), 6) AS mean,
  count(cosine_similarity_question_a) AS n FROM cosines
UNION ALL
SELECT 'cosine_similarity_question_b', round(min(cosine_similarity_question_b), 6),
  round(max(cosine_similarity_question_b), 6), round(avg(cosine_similarity_question_b), 6),
  count(cosine_similarity_question_b) FROM cosines
""",
    "cosine_histogram": _NEXT.rstrip() + ", "
    + _histogram("SELECT round(list_cosine_similarity(a, b), 9) AS v FROM pairs", "20"),
    "row_counts": f"""
WITH {_CHUNKS}
SELECT 'vectors' AS name, count(*) AS n FROM embeddings UNION ALL SELECT 'chunks', count(*) FROM chunks
UNION ALL SELECT 'questions', count(*) FROM benchmark
""",
}
