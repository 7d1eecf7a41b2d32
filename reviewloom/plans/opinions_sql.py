"""DuckDB SQL of the lexicon pipeline, as one chain of common table expressions that each query reads up to its step."""

from __future__ import annotations

from reviewloom.functions import lexicons as lx
from reviewloom.functions.text import SPACE, WORD
from reviewloom.operators.opinion import FIRST_PERSON, LISTS, PATTERNS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{SPACE}|{SPACE}$')}, '', 'g')"


def words_in(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(SPACE)}), lambda w: w <> '')"


def hits(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(w)}) AS INT)" for w in words) + ")"


def any_hit(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def first_hit(x: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {q(w)}" for w in words) + " END"


def clean(title: str, text: str) -> str:
    merged = f"concat_ws(' ', {strip(f'nullif({title}, {q(str())})')}, {strip(f'nullif({text}, {q(str())})')})"
    squeezed = f"regexp_replace({merged}, {q(SPACE)}, ' ', 'g')"
    return strip(f"regexp_replace({squeezed}, '<[^>]+>', '', 'g')")


def window(s: str, part: str, place: str, margin: int) -> str:
    start = f"greatest({place} - {margin}, 0)"
    return f"substring({s}, CAST({start} + 1 AS BIGINT), CAST(least(length({s}), {place} + length({part}) + {margin}) - {start} AS BIGINT))"


REVIEWS = """
reviews_1 AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY review_pk ORDER BY asin NULLS LAST, rating NULLS LAST, verified_purchase NULLS LAST, helpful_vote NULLS LAST, text NULLS LAST) AS n
    FROM (SELECT *, md5(concat_ws('|', coalesce(parent_asin, ''), coalesce(user_id, ''), coalesce(CAST(unix_ts AS VARCHAR), ''), coalesce(title, ''), coalesce(substring(text, 1, 100), ''))) AS review_pk FROM reviews)
  ) WHERE n = 1
)"""

META = """
meta_1 AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY title NULLS LAST, main_category NULLS LAST, description NULLS LAST, details NULLS LAST) AS n FROM meta) WHERE n = 1
)"""


def _sentences(source: str, name: str) -> str:
    return f"""
{name}_pieces AS (
  SELECT *, list_filter(list_transform(regexp_split_to_array(clean_text, '[.!?]+'), lambda p: {strip("p")}), lambda p: length(p) > 5) AS s FROM {source}
), {name} AS (
  SELECT review_pk || '_' || CAST(i AS VARCHAR) AS sentence_id, review_pk, parent_asin, unix_ts, rating, CAST(i AS INT) AS sentence_index, s[i + 1] AS target_sentence,
    CASE WHEN i > 0 THEN s[i] END AS prev_sentence, s[i + 2] AS next_sentence, concat_ws(' ', CASE WHEN i > 0 THEN s[i] END, s[i + 1], s[i + 2]) AS context_text
  FROM (SELECT *, unnest(range(len(s))) AS i FROM {name}_pieces)
)"""


NORMALIZED = f"""
normalized AS (
  SELECT review_pk, parent_asin, unix_ts, rating, {clean("title", "text")} AS clean_text, CASE WHEN nullif(title, '') IS NULL THEN 'no_title' END AS cleaning_flags FROM reviews_1
  WHERE length({clean("title", "text")}) >= 10
)"""


def _score(text: str) -> tuple[str, str, str]:
    """(reason, weight, candidate) expressions over lower-case `l` and the text itself."""
    s = "l"
    counts = {name: hits(s, words) for name, words, _, _ in LISTS}
    neg, deg = any_hit(s, lx.NEGATION), any_hit(s, lx.INTENSITY)
    score = " + ".join(f"least({counts[n]} * CAST({p} AS DOUBLE), {m})" for n, _, p, m in LISTS)
    score += f" + CASE WHEN {neg} AND {deg} THEN 1.5 WHEN {neg} THEN 0.5 ELSE 0 END + CASE WHEN contains({text}, '!') THEN 0.5 ELSE 0 END"
    score += "".join(f" + CASE WHEN regexp_matches({s}, {q(p)}) THEN {w} ELSE 0 END" for _, w, p in PATTERNS)
    score += f" + CASE WHEN regexp_matches({s}, {q(FIRST_PERSON)}) THEN 0.5 ELSE 0 END + CASE WHEN contains({text}, '?') THEN 0.3 ELSE 0 END"
    named = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({s}, {q(p)}) THEN {q(n)} END" for n, _, p in PATTERNS) + "], lambda x: x IS NOT NULL)"
    parts = [f"CASE WHEN {c} > 0 THEN '{n}(' || CAST({c} AS VARCHAR) || ')' END" for n, c in counts.items()]
    parts += [f"CASE WHEN {neg} AND {deg} THEN 'negation_intensity' WHEN {neg} THEN 'negation' END", f"CASE WHEN contains({text}, '!') THEN 'exclamation' END"]
    parts += [f"CASE WHEN len({named}) > 0 THEN 'patterns(' || array_to_string(({named})[1:3], ',') || ')' END"]
    parts += [f"CASE WHEN regexp_matches({s}, {q(FIRST_PERSON)}) THEN 'first_person' END", f"CASE WHEN contains({text}, '?') THEN 'question' END"]
    reason = f"CASE WHEN length({text}) < 10 THEN 'too_short' WHEN length({text}) > 500 THEN 'too_long' ELSE coalesce(nullif(concat_ws('+', {', '.join(parts)}), ''), 'no_opinion_signal') END"
    weight = f"round(CASE WHEN length({text}) BETWEEN 10 AND 500 THEN {score} ELSE 0 END, 4)"
    return reason, weight, f"length({text}) BETWEEN 10 AND 500"


def scored(source: str, name: str) -> str:
    reason, weight, inside = _score("target_sentence")
    return f"""
{name}_weights AS (SELECT *, {reason} AS filter_reason, {weight} AS priority_weight, {inside} AS inside FROM (SELECT *, lower(target_sentence) AS l FROM {source})),
{name} AS (SELECT * EXCLUDE (l, inside), inside AND priority_weight >= 2.0 AS is_candidate FROM {name}_weights)"""


CONTEXT = """
context AS (
  SELECT parent_asin, title AS product_title, main_category,
    CASE WHEN length(array_to_string(coalesce(features, []), ', ')) > 2048 THEN substring(array_to_string(features, ', '), 1, 2048) || '...' ELSE array_to_string(coalesce(features, []), ', ') END AS features_short,
    CASE WHEN length(description) > 2048 THEN substring(description, 1, 2048) || '...' ELSE description END AS description_short,
    CASE WHEN length(details) > 2048 THEN substring(details, 1, 2048) || '...' ELSE details END AS details_short
  FROM meta_1 WHERE parent_asin IN (SELECT parent_asin FROM reviews WHERE parent_asin IS NOT NULL)
)"""

_SEEDS = ", ".join(f"({n}, {q(w)})" for n, w in enumerate(lx.ASPECT_SEEDS))
_BEFORE, _AFTER = "[\\p{L}\\p{N}_]*[\\s\\p{Z}]*", "[\\s\\p{Z}]*[\\p{L}\\p{N}_]*"
_PHRASE = f"(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(lx.ADJECTIVES)}){SPACE}({WORD}(?:{SPACE}{WORD}){{0,2}})"
_STOPS = ", ".join(map(q, lx.STOP_NOUNS))
# regexp patterns must be constants, so each seed is a query of its own
_BY_SEED = "\n  UNION ALL ".join(
    f"SELECT sentence_id, 1 AS stage, {n} AS seed_no, place, {strip('m[place + 1]')} AS text, 0.8::DOUBLE AS confidence FROM (SELECT sentence_id, m, unnest(range(len(m))) AS place FROM (SELECT sentence_id, regexp_extract_all(lower(target_sentence), {q(_BEFORE + w + _AFTER)}) AS m FROM opinions_in WHERE contains(lower(target_sentence), {q(w)})))"
    for n, w in enumerate(lx.ASPECT_SEEDS)
)

CANDIDATES = f"""
opinions_in AS (SELECT s.*, product_title, features_short FROM scored s LEFT JOIN context USING (parent_asin) WHERE is_candidate),
seeds(n, w) AS (VALUES {_SEEDS}),
raw_candidates AS (
  {_BY_SEED}
  UNION ALL SELECT sentence_id, 2, 0, place, {strip("m[place + 1]")} AS text, 0.6 FROM (SELECT sentence_id, m, unnest(range(len(m))) AS place FROM (SELECT sentence_id, regexp_extract_all(lower(target_sentence), {q(_PHRASE)}, 1) AS m FROM opinions_in)) WHERE {strip("m[place + 1]")} NOT IN ({_STOPS})
  UNION ALL SELECT sentence_id, 3, n, 0, w, 0.5 FROM opinions_in JOIN seeds ON contains(lower(context_text), w) WHERE {any_hit("lower(target_sentence)", lx.PRONOUNS)}
),
unique_candidates AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id, text ORDER BY stage, seed_no, place) AS k FROM raw_candidates WHERE len(regexp_split_to_array(text, {q(SPACE)})) <= 3) WHERE k = 1
),
placed AS (
  SELECT c.*, o.* EXCLUDE (sentence_id), lower(o.target_sentence) AS s, strpos(lower(o.target_sentence), c.text) - 1 AS spot,
    coalesce(lower(product_title) || ' ', '') || coalesce(lower(features_short), '') AS meta_text
  FROM unique_candidates c JOIN opinions_in o USING (sentence_id) WHERE c.text NOT IN ({_STOPS}) AND length(c.text) >= 2
),
boosted AS (
  SELECT * EXCLUDE (confidence), confidence + CASE WHEN meta_text <> '' AND len(list_filter(regexp_split_to_array(text, {q(SPACE)}), lambda w: contains(meta_text, w))) > 0 THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN spot >= 0 AND {any_hit(window("s", "text", "spot", 20), lx.POSITIVE + lx.NEGATIVE)} THEN 0.1::DOUBLE ELSE 0 END AS confidence FROM placed
),
ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sentence_id ORDER BY confidence DESC, stage, seed_no, place, text) AS INT) AS candidate_rank FROM boosted) WHERE candidate_rank <= 5)"""

_NEAR = window("s", "text", "greatest(spot, 0)", 30)
_IS = f"concat(text, {q(f'{SPACE}(?:is|are|was|were){SPACE}({WORD}(?:{SPACE}{WORD})?)')})"
_DOES = f"concat(text, {q(f'{SPACE}({WORD}){SPACE}({WORD})')})"
OPINIONS = f"""
weighed AS (SELECT *, {hits(_NEAR, lx.POSITIVE)} AS p, {hits(_NEAR, lx.NEGATIVE)} AS n, {any_hit(_NEAR, lx.FLIPS)} AS f, {window("s", "text", "spot", 15)} AS near, substring(target_sentence, 1, 100) AS evidence_text FROM ranked),
rated AS (SELECT *, CASE WHEN f THEN n ELSE p END / CAST(p + n AS DOUBLE) AS r, {first_hit("near", lx.POSITIVE + lx.NEGATIVE)} AS word, {words_in("near")} AS ws FROM weighed WHERE p + n > 0),
opinions AS (
  SELECT sentence_id, candidate_rank, parent_asin, rating, text AS aspect_raw, CASE WHEN r > 0.6 THEN 'positive' WHEN r < 0.4 THEN 'negative' ELSE 'neutral' END AS sentiment,
    round(CASE WHEN r > 0.6 THEN r WHEN r < 0.4 THEN 1 - r ELSE 0.5 END, 6) AS sentiment_score, evidence_text,
    coalesce(CASE WHEN spot >= 0 THEN coalesce(
      {strip(f"nullif(regexp_extract(near, {_IS}, 1), '')")},
      nullif(regexp_extract(near, {_DOES}, 1), '') || ' ' || nullif(regexp_extract(near, {_DOES}, 2), ''),
      'too ' || nullif(regexp_extract(near, {q(f"too{SPACE}({WORD})")}, 1), ''),
      'not ' || nullif(regexp_extract(near, {q(f"not{SPACE}({WORD})")}, 1), ''),
      CASE WHEN word IS NOT NULL THEN concat_ws(' ', word, CASE WHEN list_position(ws, word) > 1 THEN ws[list_position(ws, word) - 1] END, CASE WHEN list_position(ws, word) > 0 THEN ws[list_position(ws, word) + 1] END) END) END,
      array_to_string(({words_in("lower(evidence_text)")})[1:5], ' ')) AS issue_raw
  FROM rated
)"""

_SYN = ", ".join(f"({i}, {q(k)}, {q(v)})" for i, (k, v) in enumerate(lx.ASPECT_SYNONYMS.items()))
_NOISE = ", ".join(map(q, lx.NOISE_TERMS))
_NOISE_ISSUES = ", ".join(map(q, lx.NOISE_ISSUES))


#: The synonyms of the table in the order of their originals.
TABLE_SYNONYMS = """syn AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, k, v FROM (
  SELECT k, max(v) AS v FROM (SELECT lower(regexp_replace(original, '^\\s+|\\s+$', '', 'g')) AS k, lower(regexp_replace(normalized, '^\\s+|\\s+$', '', 'g')) AS v FROM aspect_synonyms) WHERE k <> '' AND v <> '' GROUP BY 1))"""


def cascade(source: str, synonyms: str = f"syn(i, k, v) AS (VALUES {_SYN})") -> str:
    return f"""
{synonyms},
aspects AS (SELECT DISTINCT aspect_raw, coalesce({strip("lower(aspect_raw)")}, '') AS a FROM {source}),
pairs AS (
  SELECT aspect_raw, a, i, k, v, length(k) / CAST(length(a) AS DOUBLE) AS part, len(list_intersect(list_distinct({words_in("a")}), list_distinct({words_in("k")}))) AS common, len(list_distinct(list_concat({words_in("a")}, {words_in("k")}))) AS total
  FROM aspects CROSS JOIN syn WHERE a <> ''
),
cascade AS (
  SELECT aspects.aspect_raw,
    CASE WHEN a = '' THEN '' WHEN e IS NOT NULL THEN e WHEN p.part > 0.5 THEN p.v WHEN w.v IS NOT NULL THEN w.v ELSE a END AS aspect_norm,
    CASE WHEN a = '' THEN 'empty' WHEN e IS NOT NULL THEN 'exact' WHEN p.part > 0.5 THEN 'partial' WHEN w.v IS NOT NULL THEN 'keyword' ELSE 'none' END AS method,
    round(CASE WHEN a = '' THEN 0 WHEN e IS NOT NULL THEN 1 WHEN p.part > 0.5 THEN p.part WHEN w.v IS NOT NULL THEN w.j ELSE 0 END, 6) AS confidence
  FROM aspects
  LEFT JOIN (SELECT k AS a, v AS e FROM syn) USING (a)
  LEFT JOIN (SELECT * FROM (SELECT aspect_raw, v, part, row_number() OVER (PARTITION BY aspect_raw ORDER BY part DESC, i) AS r FROM pairs WHERE contains(a, k)) WHERE r = 1) p ON p.aspect_raw = aspects.aspect_raw
  LEFT JOIN (SELECT * FROM (SELECT aspect_raw, v, common / CAST(total AS DOUBLE) AS j, row_number() OVER (PARTITION BY aspect_raw ORDER BY common / CAST(total AS DOUBLE) DESC, i) AS r FROM pairs WHERE common >= 0.5 * total) WHERE r = 1) w ON w.aspect_raw = aspects.aspect_raw
)"""


def validity(a: str, i: str) -> str:
    noise = f"{strip(f'lower({a})')} IN ({_NOISE}) OR len(list_filter({words_in(f'lower({a})')}, lambda w: w NOT IN ({_NOISE}))) = 0"
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({i}, '') = '' THEN 'INVALID' WHEN {noise} OR {strip(f'lower({i})')} IN ({_NOISE_ISSUES}) THEN 'NOISE' ELSE 'VALID' END"


CONFLICT = "CASE WHEN rating >= 4 AND sentiment = 'negative' OR rating <= 2 AND sentiment = 'positive' THEN 'RATING_CONFLICT' END"
JUDGED = (
    cascade("opinions")
    + f""",
judged AS (SELECT o.*, aspect_norm, {strip("lower(issue_raw)")} AS issue_norm, {validity("aspect_norm", strip("lower(issue_raw)"))} AS validity_label, {CONFLICT} AS quality_flags FROM opinions o JOIN cascade USING (aspect_raw)),
judged_1 AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id, aspect_norm, issue_norm ORDER BY candidate_rank) AS k FROM judged) WHERE k = 1)"""
)


def chain(*steps: str) -> str:
    return "WITH " + ", ".join(steps) + "\n"


SENTENCES = _sentences("normalized", "sentences")
TO_SCORES = (REVIEWS, NORMALIZED, SENTENCES, scored("sentences", "scored"))
TO_CANDIDATES = (*TO_SCORES, META, CONTEXT, CANDIDATES)
TO_OPINIONS = (*TO_CANDIDATES, OPINIONS)
TO_JUDGED = (*TO_OPINIONS, JUDGED)
_DOCS = f"normalized AS (SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS review_pk, parent_asin, epoch(fetched_at) AS unix_ts, CAST(NULL AS DOUBLE) AS rating, {clean('NULL::VARCHAR', 'text')} AS clean_text FROM documents) WHERE length(clean_text) >= 10)"

SECONDS = "CASE WHEN unix_ts >= 100000000000 THEN unix_ts // 1000 ELSE unix_ts END"
ORACLES = {
    "s02_review_keys": chain(REVIEWS) + "SELECT review_pk, parent_asin, unix_ts, rating FROM reviews_1",
    "j01_selected_reviews": chain(REVIEWS)
    + f"""SELECT review_pk, r.parent_asin, asin, user_id, unix_ts, rating, verified_purchase, helpful_vote, r.title AS review_title, m.title AS product_title, main_category
FROM reviews_1 r LEFT JOIN meta m ON r.parent_asin = m.parent_asin WHERE {SECONDS} BETWEEN 1650000000 AND 1720000000 AND helpful_vote >= 0""",
    "x14_epoch_seconds": f"SELECT CAST(year(make_timestamp(s * 1000000)) AS INT) AS year, count(*) AS n_reviews, min(s) AS first, max(s) AS last FROM (SELECT {SECONDS} AS s FROM reviews WHERE unix_ts IS NOT NULL) GROUP BY 1",
    "v02_slice_ids": "SELECT DISTINCT main_category, parent_asin, substring(md5(concat_ws('|', 'category:' || nullif(main_category, ''), 'asin:' || nullif(parent_asin, ''), 'time:1-2')), 1, 12) AS data_slice_id FROM meta",
    "f02_product_slice": chain(REVIEWS)
    + """SELECT review_pk, r.parent_asin, rating, m.title AS product_title FROM reviews_1 r LEFT JOIN meta m ON r.parent_asin = m.parent_asin
WHERE r.parent_asin = (SELECT parent_asin FROM reviews WHERE parent_asin IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "f01_category_slice": chain(REVIEWS) + "SELECT r.parent_asin, count(*) AS n_reviews FROM reviews_1 r JOIN meta m ON r.parent_asin = m.parent_asin WHERE main_category = 'Home' AND verified_purchase = true GROUP BY 1",
    "o01_first_reviews": chain(REVIEWS) + "SELECT review_pk, m.title AS product_title FROM reviews_1 r LEFT JOIN meta m ON r.parent_asin = m.parent_asin ORDER BY review_pk, m.title NULLS LAST, main_category NULLS LAST LIMIT 100",
    "j08_meta_context": chain(META, CONTEXT) + "SELECT * FROM context",
    "x03_normalized_reviews": chain(REVIEWS, NORMALIZED) + "SELECT * FROM normalized",
    "x04_sentences": chain(REVIEWS, NORMALIZED, SENTENCES) + "SELECT * FROM sentences",
    "x04_document_sentences": chain(_DOCS, SENTENCES) + "SELECT sentence_id, target_sentence, context_text FROM sentences",
    "opinion_scores": chain(*TO_SCORES) + "SELECT sentence_id, is_candidate, filter_reason, priority_weight FROM scored",
    "opinion_scores_of_stored": chain("stored AS (SELECT DISTINCT target_sentence FROM review_sentences WHERE target_sentence IS NOT NULL)", scored("stored", "scored")) + "SELECT target_sentence, is_candidate, filter_reason, priority_weight FROM scored",
    "a22_score_histogram": chain(*TO_SCORES) + "SELECT CAST(floor(priority_weight) AS INT) AS score, count(*) AS n_sentences FROM scored GROUP BY 1",
    "t07_aspect_candidates": chain(*TO_CANDIDATES) + "SELECT sentence_id, candidate_rank, text, stage, round(confidence, 4) AS confidence FROM ranked",
    "t11_opinions": chain(*TO_OPINIONS) + "SELECT sentence_id, aspect_raw, sentiment, sentiment_score, issue_raw, evidence_text FROM opinions",
    "t12_debug_features": chain(*TO_OPINIONS)
    + f"""SELECT sentence_id, text AS aspect_raw, CAST(to_json({{'matched_seed': CASE WHEN stage <> 2 THEN w END, 'sentiment_words': CASE WHEN spot >= 0 THEN list_filter([{", ".join(map(q, lx.POSITIVE + lx.NEGATIVE))}], lambda x: contains({window("s", "text", "spot", 20)}, x)) ELSE [] END,
      'extraction_pattern': CAST(NULL AS VARCHAR)}}) AS VARCHAR) AS debug_features FROM rated JOIN (SELECT n AS n_seed, w FROM seeds) ON n_seed = seed_no""",
    "n16_judged_opinions": chain(*TO_JUDGED) + "SELECT sentence_id, aspect_norm, issue_norm, sentiment, sentiment_score, validity_label, quality_flags FROM judged_1",
    "a26_judge_counts": chain(*TO_JUDGED) + "SELECT validity_label, count(*) AS n_opinions FROM judged_1 GROUP BY 1",
    "n07_normalized_aspects": chain(cascade("aspect_sentiment_valid")) + "SELECT * FROM cascade",
    "n01_taxonomy_aspects": chain(cascade("aspect_sentiment_valid", TABLE_SYNONYMS)) + "SELECT * FROM cascade",
    "n11_validity": f"SELECT DISTINCT aspect_norm, issue_norm, rating, sentiment, {validity('aspect_norm', 'issue_norm')} AS validity, {CONFLICT} AS conflict FROM aspect_sentiment_valid",
    "n12_unfound_evidence": """SELECT v.run_id, v.sentence_id, aspect_norm, 'EVIDENCE_NOT_FOUND' AS issue_type FROM aspect_sentiment_valid v
JOIN (SELECT DISTINCT run_id, sentence_id, target_sentence FROM review_sentences) s ON v.run_id = s.run_id AND v.sentence_id = s.sentence_id
WHERE NOT contains(lower(target_sentence), lower(coalesce(evidence_text, '')))""",
    "s10_run_opinions": chain(*TO_JUDGED)
    + """SELECT sentence_id, parent_asin, aspect_norm, issue_norm, sentiment, sentiment_score, evidence_text, quality_flags FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id, aspect_norm, issue_norm ORDER BY aspect_raw) AS n FROM judged WHERE validity_label = 'VALID') WHERE n = 1""",
    "flagship": chain(*TO_JUDGED)
    + """SELECT main_category, aspect_norm, count(*) AS n_opinions, round(avg(CASE WHEN sentiment IN ('negative', 'neg') THEN 1.0 ELSE 0.0 END), 6) AS neg_ratio
FROM judged LEFT JOIN (SELECT parent_asin, main_category FROM meta_1) USING (parent_asin) WHERE validity_label = 'VALID' GROUP BY 1, 2""",
}
