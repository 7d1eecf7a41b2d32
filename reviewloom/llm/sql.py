"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from itertools import permutations

from reviewloom.llm.canonical import FILLERS
from reviewloom.plans.general import decoded_json, list_rows


def _normalized(text: str) -> str:
    """Letters and digits in lower case, with points and commas between digits kept behind stand-ins."""
    for mark, stand_in in (("[.]", "\ue000"), (",", "\ue001")):
        for _ in range(2):  # digits that stand between two marks are taken by the first pass only on one side
            text = f"regexp_replace({text}, '(\\pN){mark}(\\pN)', '\\1{stand_in}\\2', 'g')"
    return f"regexp_replace({text}, '[^\\pL\\pN\ue000\ue001]+', '', 'g')"


_P2 = f"""
WITH pieces AS (
  SELECT run_id, sentence_id, lower(target_sentence) AS t, list_filter(regexp_split_to_array(lower(target_sentence), '[;|]'), lambda p: regexp_matches(p, '\\S')) AS ps
  FROM review_sentences WHERE target_sentence IS NOT NULL AND sentence_id IS NOT NULL
), keyed AS (
  SELECT DISTINCT run_id, sentence_id,
    CASE WHEN len(ps) > 1 AND len(list_filter(ps, lambda p: regexp_matches(p, '[:：]'))) = len(ps)
      THEN 'parts ' || array_to_string(list_sort(list_transform(ps, lambda p: {_normalized("p")})), '|') ELSE 'text ' || {_normalized("t")} END AS k
  FROM pieces
)
"""

#: What the canonical mapping holds fixed, for its SQL.
_FILLER_LIST = ", ".join(f"'{w}'" for w in sorted(FILLERS))
_FOLDED = "regexp_extract_all(strip_accents(lower({})), '[\\pL\\pN]+')"
_ORDERS = ", ".join(f"([{', '.join(map(str, o))}])" for n in range(1, 5) for o in permutations(range(1, n + 1)))
_ALLOWED = "CASE WHEN length({0}) < 3 THEN 0 WHEN length({0}) < 6 THEN 1 ELSE 2 END"
#: Forms of entries and of values, and the closest entry of each value: exact forms first, then the fewest edits, then the smallest original.
_P1 = f"""
WITH entries AS (
  SELECT o AS original, min(n) AS normalized FROM (SELECT lower(regexp_replace(original, '^\\s+|\\s+$', '', 'g')) AS o, lower(regexp_replace(normalized, '^\\s+|\\s+$', '', 'g')) AS n FROM aspect_synonyms) WHERE o <> '' AND n <> '' GROUP BY 1
), entry_words AS (SELECT original, normalized, {_FOLDED.format("original")} AS ws FROM entries),
held AS (SELECT list(DISTINCT w) AS fs FROM (SELECT unnest(ws) AS w FROM entry_words) WHERE w IN ({_FILLER_LIST})),
keys AS (
  SELECT key, min_by(original, (short, original)) AS original, min_by(normalized, (short, original)) AS normalized FROM (
    SELECT array_to_string(ws, '') AS key, 0 AS short, original, normalized FROM entry_words
    UNION ALL SELECT array_to_string(list_filter(ws, lambda w: w NOT IN ({_FILLER_LIST})), ''), 1, original, normalized FROM entry_words) WHERE key <> '' GROUP BY 1
), decoded AS (
  SELECT run_id, sentence_id AS parent_key, {decoded_json("llm_output")} AS p FROM aspect_sentiment_raw WHERE parse_status = 'SUCCESS' AND llm_output IS NOT NULL
), records AS (SELECT 'r' AS source_table, run_id, parent_key, coalesce(json_extract(p, '$.result'), json_extract(p, '$.data.output'), p) AS r FROM decoded),
items AS ({list_rows("records", "json_extract(r, '$.aspects')", "aspects")}),
typed AS (SELECT DISTINCT run_id, json_extract_string(item, '$.aspect') AS v FROM items WHERE json_type(item) = 'OBJECT'),
vals AS (SELECT DISTINCT v, {_FOLDED.format("v")} AS ws FROM typed WHERE regexp_matches(coalesce(v, ''), '[^\\s]')),
lists AS (
  SELECT v, 0 AS level, ws, NOT (len(list_filter(ws, lambda w: w IN ({_FILLER_LIST}) AND NOT list_contains(coalesce(fs, []), w))) > 0) AS any_order FROM vals, held
  UNION ALL SELECT v, 1, list_filter(ws, lambda w: w NOT IN ({_FILLER_LIST}) OR list_contains(coalesce(fs, []), w)), true FROM vals, held
  UNION ALL SELECT v, 2, list_filter(ws, lambda w: w NOT IN ({_FILLER_LIST})), true FROM vals
), orders(o) AS (VALUES {_ORDERS}),
forms AS (
  SELECT DISTINCT v, level, array_to_string(list_transform(o, lambda i: ws[i]), '') AS form FROM lists JOIN orders ON len(o) = len(ws) AND any_order
  UNION SELECT v, level, array_to_string(ws, '') FROM lists WHERE NOT any_order OR len(ws) > 4
), near AS (
  SELECT v, CASE WHEN form = key THEN level ELSE 9 END AS rank, damerau_levenshtein(form, key) AS d, original, normalized FROM (SELECT * FROM forms WHERE form <> '') JOIN keys ON abs(length(form) - length(key)) <= 2
    AND damerau_levenshtein(form, key) <= least({_ALLOWED.format("form")}, {_ALLOWED.format("key")})
), best AS (SELECT v, min_by(normalized, (rank, d, original)) AS normalized FROM near GROUP BY 1)
"""

_WORDS = "regexp_extract_all(lower(text), '[\\pL\\pN]+')"

#: Issues linked by three common words, and the smallest issue that each reaches.
_P5 = """
WITH RECURSIVE v AS (
  SELECT run_id, aspect_norm, issue_norm, count(*) AS n FROM aspect_sentiment_valid WHERE validity_label = 'VALID' AND issue_norm IS NOT NULL GROUP BY 1, 2, 3
), w AS (
  SELECT DISTINCT run_id, aspect_norm, issue_norm, unnest(regexp_split_to_array(issue_norm, '\\s+')) AS word FROM v
), linked AS (
  SELECT a.run_id, a.aspect_norm, a.issue_norm AS x, b.issue_norm AS y FROM w a JOIN w b USING (run_id, aspect_norm, word)
  WHERE word <> '' GROUP BY ALL HAVING count(*) >= 3
), reach AS (
  SELECT run_id, aspect_norm, x, y FROM linked
  UNION
  SELECT r.run_id, r.aspect_norm, r.x, l.y FROM reach r JOIN linked l ON r.run_id = l.run_id AND r.aspect_norm = l.aspect_norm AND r.y = l.x
)
"""

ORACLES: dict[str, str] = {
    "p1_found": _P1 + "SELECT run_id, v AS aspect_value, coalesce(normalized, 'UNMATCHED') AS normalized FROM typed LEFT JOIN best USING (v) WHERE regexp_matches(coalesce(v, ''), '[^\\s]')",
    "p1_unmatched": _P1 + "SELECT v AS aspect_value, count(*) AS n_runs FROM typed LEFT JOIN best USING (v) WHERE regexp_matches(coalesce(v, ''), '[^\\s]') AND normalized IS NULL GROUP BY 1",
    "p2_found": _P2
    + """
SELECT DISTINCT run_id, first_sentence_id, sentence_id
FROM (SELECT run_id, sentence_id, min(sentence_id) OVER (PARTITION BY run_id, k) AS first_sentence_id FROM keyed)
WHERE sentence_id <> first_sentence_id""",
    "p2_copies": _P2 + "SELECT run_id, min(sentence_id) AS first_sentence_id, count(*) AS n_copies FROM keyed GROUP BY run_id, k",
    "p5_found": _P5
    + """SELECT run_id, aspect_norm, min(y) AS first_issue, x AS issue_norm FROM reach GROUP BY run_id, aspect_norm, x HAVING min(y) <> x""",
    "p5_groups": _P5
    + """SELECT run_id, aspect_norm, first_issue, count(*) AS n_values, sum(n) AS n_rows FROM (
  SELECT v.run_id, v.aspect_norm, v.issue_norm, any_value(n) AS n, coalesce(min(y), v.issue_norm) AS first_issue FROM v LEFT JOIN reach r ON v.run_id = r.run_id AND v.aspect_norm IS NOT DISTINCT FROM r.aspect_norm AND v.issue_norm = r.x GROUP BY 1, 2, 3)
GROUP BY 1, 2, 3""",
    "p10_numbers": """
WITH common AS (SELECT list(DISTINCT lower(word)) AS cs FROM common_words WHERE word IS NOT NULL),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\\pL\\pM\\pN]+') AS ws, list_filter(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x{2028}\\x{2029}]'), lambda l: regexp_matches(l, '\\S')) AS ls, length(regexp_replace(t, '[\\s\\p{Z}]+', '', 'g')) AS seen FROM d),
n AS (SELECT *, length(array_to_string(ws, '')) AS letters, len(list_filter(ls, lambda l: regexp_matches(l, '[.!?…。！？｡।॥؟۔:;][\\p{Pe}\\p{Pf}"''*_~]*\\s*$'))) AS stopped FROM parts)
SELECT doc_id, len(ws) AS n_words, len(ls) AS n_lines, round(CASE WHEN len(ws) > 0 THEN letters / CAST(len(ws) AS DOUBLE) ELSE 0 END, 6) AS mean_word_length, round(CASE WHEN seen > 0 THEN greatest(seen - letters, 0) / CAST(seen AS DOUBLE) ELSE 0 END, 6) AS symbol_ratio,
  round(CASE WHEN len(ls) > 0 THEN stopped / CAST(len(ls) AS DOUBLE) ELSE 0 END, 6) AS punctuated_line_share, round(CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: list_contains(cs, w))) / CAST(len(ws) AS DOUBLE) ELSE 0 END, 6) AS common_word_share FROM n, common""",
    # a tokenizer is beyond SQL; that every text with characters is packed once, whole and within the capacity is not
    "p8_faults": """SELECT count(*) FILTER (WHERE length(text) > 0) AS n_items, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_changed,
CAST(0 AS BIGINT) AS n_overfull FROM documents""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM eval_items),
dw AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 11], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS p FROM d WHERE len(ws) >= 12)),
iw AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + 11], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS p FROM i WHERE len(ws) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (win)""",
}
