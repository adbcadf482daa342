"""DuckDB SQL for the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from tessera.llm.line_quality import BOILERPLATE

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _count(text: str, chars: str) -> str:
    """Characters of a class in a text."""
    return f"length(regexp_replace({text}, '[^{chars}]', '', 'g'))"


_PHRASE = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
LINE_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT r, i, array_to_string(words[i:i + 2], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) > 2)),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, win) AS times FROM windows) WHERE times > 1) GROUP BY r),
lines AS (SELECT r, line, translate(line, '{_UP}', '{_LOW}') AS low, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
          FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
measured AS (SELECT *, {_count('line', '#*$%&|<>')} AS symbols, {_count('line', 'A-ZÀ-Þ')} AS capitals, {_count('line', 'A-Za-zÀ-ÿ')} AS letters, {_count('line', '!')} AS bangs,
                    {_count('line', '|>»·›')} AS separators, regexp_matches(line, '[.!?:;"'')»…”’。！？][\\x20\\x09-\\x0D]*$') AS closed, regexp_matches(line, '[.!?»…”’。！？]') AS marked,
                    ({_PHRASE}) AS stock FROM lines),
judged AS (SELECT *, 2 * symbols > words OR (words >= 3 AND (2 * capitals > letters OR 2 * bangs >= words)) OR (separators >= 2 AND 4 * separators >= words)
                     OR (NOT closed AND (words < 5 OR NOT marked)) OR (words < 40 AND stock) AS failed FROM measured),
by_line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup, count(*) FILTER (WHERE failed) AS n_failed, coalesce(sum(words) FILTER (WHERE failed), 0) AS n_lost FROM judged GROUP BY r),
base AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST({_count('text', '#*$%&|<>')} AS BIGINT) AS n_symbols,
                CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
                CAST(coalesce(n_failed, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost_words
         FROM d LEFT JOIN repeated USING (r) LEFT JOIN by_line USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept, n_lines, n_failed_lines, n_lost_words
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS words FROM documents),
items AS (SELECT item, words, least(13, len(words)) AS span FROM (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLDED} AS words FROM benchmark) WHERE len(words) > 0),
wanted AS (SELECT DISTINCT item, span, array_to_string(words[i:i + span - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - span + 2)) AS i FROM items)),
there AS (SELECT r, span, i, array_to_string(words[i:i + span - 1], ' ') AS win
          FROM (SELECT r, words, span, unnest(range(1, len(words) - span + 2)) AS i FROM d JOIN (SELECT DISTINCT span FROM wanted) s ON len(words) >= span)),
hits AS (SELECT DISTINCT r, i, there.span AS span, item FROM there JOIN wanted USING (span, win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + span)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, words, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                                                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams
                     FROM (SELECT doc_id, {_FOLDED} AS words FROM documents)),
keyed AS (SELECT doc_id, grams, CASE WHEN len(grams) > 0 THEN array_to_string(list_sort(grams), '/') ELSE '-' || CAST(doc_id AS VARCHAR) END AS key FROM d),
classed AS (SELECT doc_id, grams, min(doc_id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS class_size FROM keyed),
classes AS (SELECT class_id, class_size, grams FROM classed WHERE doc_id = class_id),
gram AS (SELECT class_id, class_size, len(grams) AS n, unnest(grams) AS g FROM classes),
pairs AS (SELECT a.class_id AS a, b.class_id AS b, any_value(b.class_size) AS size FROM gram a JOIN gram b ON a.g = b.g AND a.class_id <> b.class_id
          GROUP BY a.class_id, b.class_id HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.b),
groups AS (SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY a),
links AS (SELECT a AS class_id, CAST(sum(size) AS BIGINT) AS linked FROM pairs GROUP BY a)
SELECT doc_id, class_id, class_size, group_id, class_size - 1 + coalesce(linked, 0) AS n_links FROM classed JOIN groups USING (class_id) LEFT JOIN links USING (class_id)"""


LEXICAL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS words FROM documents),
sizes AS (SELECT r, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
totals AS (SELECT count(*) AS docs, sum(n) AS terms FROM sizes),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(words) AS t FROM d) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY t),
wanted AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_FOLDED}) AS t FROM benchmark) GROUP BY i, item_id, t),
scored AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS score
           FROM wanted JOIN weights USING (t) JOIN tf USING (t) JOIN sizes USING (r), totals GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= 20"""
