"""Queries of the clustering kernels, the providers' stand-ins, and the judged model payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import lexicons as lx
from reviewloom.operators import kernels, neighbor_graph, normalize, payloads, providers, reports
from reviewloom.operators.selection import build_sentences, distinct_reviews, first_per, meta_context, normalize_reviews
from reviewloom.operators.flatten import flatten_nested
from reviewloom.plans.general import PAYLOAD_FIELDS, decoded_json, list_rows
from reviewloom.plans.opinions_sql import CONTEXT, META, NORMALIZED, REVIEWS, SENTENCES, cascade, chain, q, strip, validity, words_in
from reviewloom.plans.reports import _REPS, _SAMPLES, _STATS
from reviewloom.sources.tables import table


def c01_encoded_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all different issues, from the stand-in encoder."""
    v = providers.encode_texts(table(spark, sf_dir, "aspect_sentiment_valid"), "issue_norm")
    return v.select("text", F.size("vector").alias("dimensions"), F.round(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x), 6).alias("squares"))


def c02_issue_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding made distinct before and joined back after: rows per aspect that got a vector."""
    valid = table(spark, sf_dir, "aspect_sentiment_valid").where("validity_label = 'VALID'")
    v = providers.encode_texts(valid, "issue_norm")
    joined = valid.join(v, F.col("issue_norm") == F.col("text"))
    return joined.groupBy("aspect_norm").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("text").alias("n_texts"))


def c04_merged_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names of the aspects of the stored opinions."""
    names = table(spark, sf_dir, "aspect_sentiment_valid").where("aspect_norm <> ''").groupBy(F.col("aspect_norm").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    v = providers.encode_texts(names, "text")
    return kernels.merge_names(names.join(v, "text"), "text", "vector", "n", 0.5)


def c06_bucket_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each aspect and run clustered by the method that fits their number."""
    valid = table(spark, sf_dir, "aspect_sentiment_valid").where("validity_label = 'VALID'").select(F.concat_ws("|", "run_id", "aspect_norm").alias("bucket"), "issue_norm").distinct()
    v = providers.encode_texts(valid, "issue_norm")
    rows = valid.join(v, F.col("issue_norm") == F.col("text")).select("bucket", F.concat_ws("|", "bucket", "issue_norm").alias("k"), "vector")
    return kernels.cluster_buckets(rows, "bucket", "k", "vector")


def c06_bucket_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method of every bucket of issues, its rows, and whether labels count from 0 without gaps."""
    found = c06_bucket_clusters(spark, sf_dir).groupBy("bucket", "method").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n"), F.max("label").alias("last"))
    return found.select("bucket", "method", "n_rows", (F.col("n") == F.col("last") + 1).alias("without_gaps"))


def c03_two_stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the valid opinions are enough per aspect for clustering aspect by aspect."""
    return kernels.two_stage_gate(table(spark, sf_dir, "aspect_sentiment_valid").where("validity_label = 'VALID'"), "aspect_norm")


def s22_density_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density hierarchy of the vectors of every label."""
    return kernels.condensed_trees(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "label", "vec_id", "embedding", min_cluster_size=5)


def c07_hierarchical_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical density clustering of the vectors, in buckets."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return kernels.cluster_buckets(rows, "label", "vec_id", "embedding", method="hdbscan", min_cluster_size=5)


def c11_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the stand-in reranker between raw and normalised issues."""
    pairs = table(spark, sf_dir, "aspect_sentiment_valid").select("issue_raw", "issue_norm").distinct()
    return providers.rerank(pairs, "issue_raw", "issue_norm").select("issue_raw", "issue_norm", F.round("rerank_score", 5).alias("rerank_score"))


#: Prompt of the stand-in model of extraction.
EXTRACTION_PROMPT = "Name the aspects of the product that the sentence judges.\nSentence: {target_sentence}\nContext: {context_text}\nProduct: {product_title}\nFeatures: {features_short}"


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sentence_id, prompt) of every sentence of the reviews, with its product."""
    rows = first_per(table(spark, sf_dir, "review_sentences"), ["sentence_id"], [F.col("target_sentence").asc_nulls_last(), F.col("context_text").asc_nulls_last(), F.col("parent_asin").asc_nulls_last()])
    context = meta_context(table(spark, sf_dir, "review_sentences"), table(spark, sf_dir, "meta")).select("parent_asin", "product_title", "features_short")
    rows = rows.join(context, "parent_asin", "left")
    return rows.select("sentence_id", providers.fill_template(EXTRACTION_PROMPT, rows.columns).alias("prompt"))


def c12_reranked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the issues of an aspect that the stand-in reranker finds alike."""
    valid = table(spark, sf_dir, "aspect_sentiment_valid").where("validity_label = 'VALID'").select("aspect_norm", "issue_norm").distinct()
    rows = valid.join(providers.encode_texts(valid, "issue_norm"), F.col("issue_norm") == F.col("text")).select(F.concat_ws("|", "aspect_norm", "issue_norm").alias("k"), "aspect_norm", "text", "vector")
    return neighbor_graph.reranked_edges(rows, "k", "vector", "text", "aspect_norm", providers.CosineReranker).select("src", "dst", F.round("score", 5).alias("score"))


def l11_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all sentences, filled from the template."""
    return _prompts(spark, sf_dir)


def l04_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the stand-in model to the prompts of all sentences, with the aspects that they name."""
    answers = providers.complete_prompts(_prompts(spark, sf_dir), "sentence_id", "prompt", providers.build_completer(providers.ModelConfig("rules")))
    named = F.array_join(F.transform(F.from_json(F.get_json_object("llm_output", "$.aspects"), "array<struct<aspect:string>>"), lambda a: a["aspect"]), ",")
    return answers.select("sentence_id", "parse_status", "retry_count", named.alias("aspects"))


def n06_model_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade with the stand-ins: spelling, vectors, and a model for what is left."""
    names, _ = normalize.normalize_with_models(table(spark, sf_dir, "aspect_sentiment_valid"), embed=providers.HashedNgrams, complete=normalize.PrefixNormalizer)
    return names


def n06_new_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stand-in model adds to the synonyms after the cascade without spelling."""
    return normalize.normalize_with_models(table(spark, sf_dir, "aspect_sentiment_valid"), fuzzy=False, complete=normalize.PrefixNormalizer)[1]


def _latest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = reports.latest_rows(table(spark, sf_dir, "aspect_sentiment_raw"), ["run_id", "sentence_id"])
    return raw.select("run_id", "sentence_id", "llm_output"), table(spark, sf_dir, "review_sentences")


def n14_judged_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid opinions from the latest payloads of every run."""
    return payloads.judge_payloads(*_latest(spark, sf_dir), fuzzy=False)[0]


def n15_payload_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the latest payloads, counted per run."""
    return payloads.judge_payloads(*_latest(spark, sf_dir), fuzzy=False)[1].groupBy("run_id", "issue_type").agg(F.count(F.lit(1)).alias("n"))


def a25_payload_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspects in the latest payload of every sentence, wherever the record stands in it."""
    raw, _ = _latest(spark, sf_dir)
    listed = flatten_nested(raw, "llm_output", ["run_id", "sentence_id"], PAYLOAD_FIELDS, declared=["aspects"]).where("list_name = 'aspects'")
    found = listed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_aspects"), F.count_distinct("sentence_id").alias("n_with_aspects"))
    return raw.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_payloads")).join(found, "run_id", "left").fillna(0)


def j09_new_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged opinions of the latest payloads that the stored run does not hold."""
    judged = payloads.judge_payloads(*_latest(spark, sf_dir), fuzzy=False)[0]
    return payloads.new_opinions(judged, table(spark, sf_dir, "aspect_sentiment_valid")).select("run_id", "sentence_id", "aspect_norm", "issue_norm")


def l05_evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the stored evidence in its sentence."""
    valid = table(spark, sf_dir, "aspect_sentiment_valid").select("run_id", "sentence_id", "evidence_text").distinct()
    sentences = table(spark, sf_dir, "review_sentences").groupBy("run_id", "sentence_id").agg(F.min("target_sentence").alias("target_sentence"))
    span = payloads.evidence_span(F.col("evidence_text"), F.col("target_sentence"))
    return valid.join(sentences, ["run_id", "sentence_id"]).select("run_id", "sentence_id", "evidence_text", span.alias("span")).select("run_id", "sentence_id", "evidence_text", F.col("span.start").cast("int").alias("start_char"), F.col("span.end").cast("int").alias("end_char"))


def l08_traced_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the stored reports traced to the samples of its cluster."""
    keys = ["run_id", "aspect_norm", "cluster_id"]
    once = first_per(table(spark, sf_dir, "cluster_reports"), keys, [F.asc("created_at"), F.col("evidence_items").asc_nulls_last()])
    items = flatten_nested(once, "evidence_items", keys, root_list="evidence_items", fields=["sentence_id", "quote"])
    stats = reports.clusters_once(table(spark, sf_dir, "cluster_stats"))
    samples = reports.cluster_samples(stats, table(spark, sf_dir, "review_sentences"), table(spark, sf_dir, "aspect_sentiment_valid")).groupBy(*keys, "sentence_id", "target_sentence").agg(F.min("sample_no").alias("sample_no"))
    return payloads.trace_evidence(items.select(*keys, "ordinal", "sentence_id", "quote"), samples, keys)


def v04_rebuilt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many review keys and sentence ids of the stored runs the pipeline derives again from the reviews."""
    made = build_sentences(normalize_reviews(distinct_reviews(table(spark, sf_dir, "reviews")).withColumnsRenamed({"title": "review_title", "text": "review_text"})))
    stored = table(spark, sf_dir, "review_sentences")
    known = lambda key: stored.select(key).distinct().join(made.select(key).distinct().withColumn("known", F.lit(1)), key, "left")
    counted = [known(key).agg(F.lit(key).alias("key"), F.count(F.lit(1)).alias("n_stored"), F.count("known").alias("n_known")) for key in ("review_pk", "sentence_id")]
    return counted[0].unionByName(counted[1])


QUERIES = {f.__name__: f for f in (c01_encoded_issues, c02_issue_vectors, c03_two_stage_gate, s22_density_trees, c04_merged_aspects, c06_bucket_clusters, c06_bucket_methods, c07_hierarchical_density, c11_reranked, c12_reranked_edges, l11_prompts, l04_completed, n06_model_aspects, n06_new_synonyms, n14_judged_payloads, n15_payload_issues, a25_payload_aspects, j09_new_opinions, l05_evidence_spans, l08_traced_evidence, v04_rebuilt_ids)}

_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sentence_id ORDER BY created_at DESC, retry_count DESC, llm_model NULLS LAST, prompt_version NULLS LAST, llm_output NULLS LAST) AS k
  FROM aspect_sentiment_raw WHERE parse_status = 'SUCCESS') WHERE k = 1)"""
_TEXT = "json_extract_string(item, '$.{}')"
_JUDGED = f"""
WITH {_LATEST}, sentences AS (SELECT run_id, sentence_id, min(target_sentence) AS target_sentence FROM review_sentences GROUP BY 1, 2),
decoded AS (SELECT 'raw' AS source_table, run_id, sentence_id AS parent_key, llm_output, {decoded_json("llm_output")} AS p FROM latest JOIN sentences USING (run_id, sentence_id)),
records AS (SELECT * EXCLUDE (p), coalesce(json_extract(p, '$.result'), json_extract(p, '$.data.output'), p) AS r FROM decoded),
items AS ({list_rows("records", "json_extract(r, '$.aspects')", "aspects")}),
listed AS (
  SELECT i.run_id, parent_key AS sentence_id, CAST(item_path AS INT) AS ordinal, target_sentence, {_TEXT.format("aspect")} AS aspect_raw, {_TEXT.format("issue")} AS issue_raw, {_TEXT.format("sentiment")} AS sentiment,
    {_TEXT.format("evidence_text")} AS evidence_text, TRY_CAST({_TEXT.format("sentiment_score")} AS DOUBLE) AS sentiment_score, contains(lower(target_sentence), lower(coalesce({_TEXT.format("evidence_text")}, ''))) AS found
  FROM items i JOIN sentences s ON i.run_id = s.run_id AND i.parent_key = s.sentence_id
), {cascade("listed")},
kept AS (SELECT l.*, aspect_norm, {strip("lower(issue_raw)")} AS issue_norm FROM listed l JOIN cascade c ON l.aspect_raw = c.aspect_raw WHERE found),
judged AS (SELECT *, row_number() OVER (PARTITION BY run_id, sentence_id, aspect_norm, issue_norm ORDER BY ordinal) AS k FROM kept WHERE {validity("aspect_norm", "issue_norm")} = 'VALID')
"""
_ASKED = """asked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY target_sentence NULLS LAST, context_text NULLS LAST, parent_asin NULLS LAST) AS k FROM review_sentences) WHERE k = 1)"""
_STORED_CONTEXT = CONTEXT.replace("FROM reviews", "FROM review_sentences")
#: Evidence as a whole, or its first three words and then every further word in order, as a recursion over the words.
_SPANS = f"""WITH RECURSIVE pairs AS (
  SELECT DISTINCT v.run_id, v.sentence_id, evidence_text, lower(target_sentence) AS s, {strip("lower(evidence_text)")} AS e, coalesce(evidence_text, '') <> '' AND coalesce(target_sentence, '') <> '' AS usable
  FROM (SELECT DISTINCT run_id, sentence_id, evidence_text FROM aspect_sentiment_valid) v
  JOIN (SELECT run_id, sentence_id, min(target_sentence) AS target_sentence FROM review_sentences GROUP BY 1, 2) t ON v.run_id = t.run_id AND v.sentence_id = t.sentence_id
), worded AS (SELECT *, {words_in("e")} AS ws, strpos(s, e) - 1 AS whole FROM pairs),
headed AS (SELECT *, strpos(s, array_to_string(ws[1:3], ' ')) - 1 AS head FROM worded),
walk AS (
  SELECT run_id, sentence_id, evidence_text, s, ws, head, 0 AS i, head AS e_end, true AS open FROM headed WHERE usable AND whole < 0 AND len(ws) > 0 AND head >= 0
  UNION ALL
  SELECT run_id, sentence_id, evidence_text, s, ws, head, i + 1, CASE WHEN open AND strpos(substring(s, e_end + 1), ws[i + 1]) > 0 THEN e_end + strpos(substring(s, e_end + 1), ws[i + 1]) - 1 + length(ws[i + 1]) ELSE e_end END,
    open AND strpos(substring(s, e_end + 1), ws[i + 1]) > 0 FROM walk WHERE i < len(ws)
)
SELECT h.run_id, h.sentence_id, h.evidence_text, CAST(CASE WHEN NOT usable THEN -1 WHEN whole >= 0 THEN whole WHEN w.e_end IS NOT NULL THEN h.head ELSE -1 END AS INT) AS start_char,
  CAST(CASE WHEN NOT usable THEN -1 WHEN whole >= 0 THEN whole + length(h.evidence_text) WHEN w.e_end IS NOT NULL THEN w.e_end ELSE -1 END AS INT) AS end_char
FROM headed h LEFT JOIN walk w ON w.i = len(w.ws) AND h.run_id = w.run_id AND h.sentence_id = w.sentence_id AND h.evidence_text = w.evidence_text"""
ORACLES = {
    "n14_judged_payloads": _JUDGED + "SELECT run_id, sentence_id, aspect_norm, issue_norm, aspect_raw, sentiment, sentiment_score, evidence_text FROM judged WHERE k = 1",
    "n15_payload_issues": _JUDGED
    + """SELECT run_id, issue_type, count(*) AS n FROM (SELECT run_id, 'PARSE_FAIL' AS issue_type FROM decoded WHERE coalesce(json_type(p), '') <> 'OBJECT' UNION ALL SELECT run_id, 'EVIDENCE_NOT_FOUND' FROM listed WHERE NOT found) GROUP BY 1, 2""",
    "v04_rebuilt_ids": " UNION ALL ".join(
        f"""SELECT '{key}' AS key, count(*) AS n_stored, count(k) AS n_known FROM (SELECT DISTINCT {key} FROM review_sentences) s
      LEFT JOIN (SELECT DISTINCT {key} AS k FROM ({chain(REVIEWS, NORMALIZED, SENTENCES)} SELECT * FROM sentences)) m ON s.{key} = m.k"""
        for key in ("review_pk", "sentence_id")
    ),
    "c01_encoded_issues": "SELECT DISTINCT issue_norm AS text, CAST(64 AS INT) AS dimensions, 1.0::DOUBLE AS squares FROM aspect_sentiment_valid WHERE issue_norm IS NOT NULL",
    "c06_bucket_methods": """SELECT bucket, CASE WHEN n < 2 THEN 'single' WHEN n < 100 THEN 'agglomerative' ELSE 'hdbscan' END AS method, n AS n_rows, true AS without_gaps
      FROM (SELECT concat_ws('|', run_id, aspect_norm) AS bucket, count(DISTINCT issue_norm) AS n FROM aspect_sentiment_valid WHERE validity_label = 'VALID' AND issue_norm IS NOT NULL GROUP BY 1)""",
    "c03_two_stage_gate": "SELECT count(*) AS n_rows, count(DISTINCT aspect_norm) AS n_buckets, count(*) > 100 * count(DISTINCT aspect_norm) AS two_stages FROM aspect_sentiment_valid WHERE validity_label = 'VALID'",
    "c02_issue_vectors": "SELECT aspect_norm, count(*) AS n_rows, count(DISTINCT issue_norm) AS n_texts FROM aspect_sentiment_valid WHERE validity_label = 'VALID' AND issue_norm IS NOT NULL GROUP BY 1",
    "l11_prompts": chain(META, _STORED_CONTEXT, _ASKED)
    + """SELECT sentence_id, 'Name the aspects of the product that the sentence judges.' || chr(10) || 'Sentence: ' || coalesce(target_sentence, '') || chr(10) || 'Context: ' || coalesce(context_text, '') || chr(10)
      || 'Product: ' || coalesce(product_title, '') || chr(10) || 'Features: ' || coalesce(features_short, '') AS prompt FROM asked LEFT JOIN context USING (parent_asin)""",
    "l04_completed": chain(_ASKED)
    + f"""SELECT sentence_id, 'SUCCESS' AS parse_status, CAST(0 AS INT) AS retry_count, array_to_string(list_filter([{", ".join(map(q, lx.ASPECT_SEEDS))}], lambda w: contains(lower(split_part(coalesce(target_sentence, ''), chr(10), 1)), w)), ',') AS aspects FROM asked""",
    # what the cascade leaves open: a term of the same first four letters is no new one, noise is none
    "n06_new_synonyms": chain(cascade("aspect_sentiment_valid"))
    + f"""SELECT DISTINCT a AS original, a AS normalized FROM cascade c JOIN aspects USING (aspect_raw) WHERE method = 'none' AND a NOT IN ({", ".join(map(q, lx.NOISE_TERMS))})
      AND NOT EXISTS (SELECT 1 FROM syn WHERE left(v, 4) = left(a, 4))""",
    "a25_payload_aspects": f"""WITH {_LATEST}, decoded AS (SELECT 'raw' AS source_table, run_id, sentence_id AS parent_key, {decoded_json("llm_output")} AS p FROM latest),
      records AS (SELECT * EXCLUDE (p), coalesce(json_extract(p, '$.result'), json_extract(p, '$.data.output'), p) AS r FROM decoded), items AS ({list_rows("records", "json_extract(r, '$.aspects')", "aspects")})
      SELECT run_id, n_payloads, coalesce(n_aspects, 0) AS n_aspects, coalesce(n_with_aspects, 0) AS n_with_aspects FROM (SELECT run_id, count(*) AS n_payloads FROM latest GROUP BY 1)
      LEFT JOIN (SELECT run_id, count(*) AS n_aspects, count(DISTINCT parent_key) AS n_with_aspects FROM items GROUP BY 1) USING (run_id)""",
    "j09_new_opinions": _JUDGED
    + """SELECT run_id, sentence_id, aspect_norm, issue_norm FROM judged j WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM aspect_sentiment_valid v
      WHERE v.validity_label = 'VALID' AND v.run_id = j.run_id AND v.sentence_id = j.sentence_id AND v.aspect_norm = j.aspect_norm AND v.issue_norm = j.issue_norm)""",
    "l05_evidence_spans": _SPANS,
    # blank ids from the first sample that holds the quote or is held by it, otherwise the first; foreign ids drop; no cluster stays bare
    "l08_traced_evidence": f"""WITH {_STATS}, {_REPS}, {_SAMPLES},
      once AS (SELECT 'r' AS source_table, run_id, aspect_norm || chr(9) || cluster_id AS parent_key, {decoded_json("evidence_items")} AS e FROM (SELECT *, row_number() OVER (PARTITION BY run_id, aspect_norm, cluster_id ORDER BY created_at, evidence_items NULLS LAST) AS k FROM cluster_reports) WHERE k = 1),
      listed AS ({list_rows("once", "e", "evidence_items")}),
      items AS (SELECT run_id, split_part(parent_key, chr(9), 1) AS aspect_norm, split_part(parent_key, chr(9), 2) AS cluster_id, CAST(item_path AS INT) AS ordinal, json_extract_string(item, '$.sentence_id') AS sentence_id, json_extract_string(item, '$.quote') AS quote FROM listed),
      own AS (SELECT run_id, aspect_norm, cluster_id, sentence_id, target_sentence, min(sample_no) AS no FROM samples GROUP BY ALL),
      met AS (SELECT i.run_id, i.aspect_norm, i.cluster_id, ordinal, quote, min_by(o.sentence_id, no) FILTER (WHERE contains(lower(target_sentence), {strip("lower(quote)")}) OR contains({strip("lower(quote)")}, lower(target_sentence))) AS hit, min_by(o.sentence_id, no) AS head
        FROM items i JOIN own o ON i.run_id = o.run_id AND i.aspect_norm = o.aspect_norm AND i.cluster_id = o.cluster_id WHERE coalesce(i.sentence_id, '') = '' AND coalesce(quote, '') <> '' GROUP BY ALL),
      kept AS (
        SELECT run_id, aspect_norm, cluster_id, ordinal, sentence_id, quote FROM items i WHERE coalesce(sentence_id, '') <> '' AND EXISTS (SELECT 1 FROM own o WHERE i.run_id = o.run_id AND i.aspect_norm = o.aspect_norm AND i.cluster_id = o.cluster_id AND i.sentence_id = o.sentence_id)
        UNION ALL SELECT run_id, aspect_norm, cluster_id, ordinal, coalesce(hit, head), quote FROM met),
      bare AS (SELECT run_id, aspect_norm, cluster_id, CAST(0 AS INT) AS ordinal, min_by(sentence_id, no) AS sentence_id, substring(min_by(target_sentence, no), 1, 200) AS quote FROM own o
        WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.run_id = o.run_id AND k.aspect_norm = o.aspect_norm AND k.cluster_id = o.cluster_id) GROUP BY ALL)
      SELECT * FROM kept UNION ALL SELECT * FROM bare""",
}
