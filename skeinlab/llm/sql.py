"""DuckDB SQL for the queries whose rows SQL can give on whole tables; plain forms, without the operators' methods."""

from __future__ import annotations

from skeinlab.llm.quality_rules import COMMON_WORDS, DOUBT_CLASS, DOUBT_WORD, GUARD, MOST_CLASS

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

#: All pairs that share a run of five words, compared exactly; classes by passing on the least doc_id.
NGRAM_JACCARD = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN doc_id IS NOT NULL THEN coalesce({_WORDS}, []) ELSE [] END AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM docs WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (
  SELECT x, y, d.doc_id AS y_doc FROM common JOIN sizes s ON s.r = x JOIN sizes t ON t.r = y JOIN docs d ON d.r = y
  WHERE 10 * c >= 8 * (s.n + t.n - c)),
reached AS (
  SELECT r, doc_id AS least FROM docs
  UNION
  SELECT l.y, reached.least FROM reached JOIN links l ON l.x = reached.r WHERE reached.least < l.y_doc),
classes AS (SELECT r, min(least) AS class_id FROM reached GROUP BY r),
counts AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM docs JOIN classes USING (r) LEFT JOIN counts USING (r)
"""


def _distance(a: str, b: str) -> str:
    share = "list_transform({0}, lambda v: CASE WHEN list_sum({0}) > 0 THEN v / list_sum({0})::DOUBLE ELSE 0.0 END)"
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0.0 END"
    p, q = part.format("z[1]", "z[2]"), part.format("z[2]", "z[1]")
    return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({share.format(a)}, {share.format(b)}), lambda z: {p} + {q})) / 2))"


_LISTS = " ".join(f"WHEN '{lang}' THEN {words!r}" for lang, words in COMMON_WORDS.items())
_SLOTS = max(map(len, COMMON_WORDS.values())) + 1

QUALITY_RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, text, {_WORDS} AS w FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)),
runs AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) > 4)),
twice AS (SELECT r, i FROM runs QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(5) AS t(j) GROUP BY r),
counted AS (
  SELECT r, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(text) AS n_chars, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS capitals, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
    length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g')) AS punctuation, list_transform(w, lambda x: lower(x)) AS low, CASE lang {_LISTS} ELSE [] END AS known
  FROM docs LEFT JOIN covered USING (r)),
per_word AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    list_transform(known, lambda c: len(list_filter(low, lambda x: x = c))) AS hits FROM counted),
facts AS MATERIALIZED (
  SELECT r, doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    [word_chars - capitals - digits - punctuation - n_symbols, capitals, digits, n_chars - word_chars, punctuation, n_symbols] AS classes,
    list_append(hits, n_words - coalesce(list_sum(hits), 0)::BIGINT) AS words FROM per_word),
reference AS (
  SELECT lang AS of_lang, [{", ".join(f"sum(classes[{i + 1}])" for i in range(6))}] AS ref_classes,
    list_filter([{", ".join(f"sum(words[{i + 1}])" for i in range(_SLOTS))}], lambda x: x IS NOT NULL) AS ref_words FROM facts GROUP BY lang),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_distance("classes", "ref_classes")} AS c, {_distance("words", "ref_words")} AS d
  FROM facts JOIN reference ON lang IS NOT DISTINCT FROM of_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {GUARD} OR (c <= {MOST_CLASS} AND (c <= {DOUBT_CLASS} OR d <= {DOUBT_WORD}))) AS kept, round(c, 6) AS class_distance, round(d, 6) AS word_distance
FROM judged
"""

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": NGRAM_JACCARD, "op2_quality_rules": QUALITY_RULES}
