"""Queries of evaluation, reports and exports over the stored stages of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import opinion, reports
from reviewloom.operators.flatten import flatten_nested
from reviewloom.operators.ordering import numbered
from reviewloom.operators.selection import first_per
from reviewloom.plans.general import decoded_json, list_rows
from reviewloom.plans.opinions_sql import q, scored
from reviewloom.sources import sinks
from reviewloom.sources.tables import table

KEYS = ["run_id", "aspect_norm", "cluster_id"]


def w01_latest_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest successful extraction per sentence of a run."""
    return reports.latest_rows(table(spark, sf_dir, "aspect_sentiment_raw"), ["run_id", "sentence_id"]).select("run_id", "sentence_id", "retry_count", "llm_model", "prompt_version")


def w02_first_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest opinion per sentence and raw aspect."""
    order = [F.desc("created_at"), *[F.col(c).asc_nulls_last() for c in ("issue_norm", "sentiment", "sentiment_score", "evidence_text")]]
    return first_per(table(spark, sf_dir, "aspect_sentiment_valid"), ["run_id", "sentence_id", "aspect_raw"], order).select("run_id", "sentence_id", "aspect_raw", "issue_norm", "sentiment")


def a01_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, distinct sentences and labels of each run in one pass."""
    v = table(spark, sf_dir, "aspect_sentiment_valid")
    label = lambda name: F.count_if(F.col("validity_label") == name).alias(f"n_{name.lower()}")
    return v.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("sentence_id").alias("n_sentences"), label("VALID"), label("NOISE"), label("INVALID"), F.round(F.avg("sentiment_score"), 6).alias("mean_score"))


def a04_duplicate_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most repeated opinions."""
    keys = ["run_id", "sentence_id", "aspect_norm", "issue_norm"]
    counts = table(spark, sf_dir, "aspect_sentiment_valid").where("validity_label = 'VALID'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.orderBy(F.desc("n"), *keys).limit(10)


def a05_aspect_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspects named more than once in a sentence; normal if every issue differs."""
    g = table(spark, sf_dir, "aspect_sentiment_valid").where("validity_label = 'VALID'").groupBy("run_id", "sentence_id", "aspect_norm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("issue_norm").alias("n_issues")).where("n > 1")
    return g.withColumn("verdict", F.when(F.col("n") == F.col("n_issues"), "normal").otherwise("duplicate"))


def a06_busy_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with more than ten valid opinions."""
    return reports.busy_sentences(table(spark, sf_dir, "aspect_sentiment_valid"))


def a08_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "review_sentences").select("run_id", "parent_asin").distinct()


def a24_coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each run in tall form."""
    sentences = table(spark, sf_dir, "review_sentences").groupBy("run_id", "sentence_id").agg(F.min("target_sentence").alias("target_sentence"))
    s = opinion.score_sentences(sentences).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("is_candidate").alias("n_candidates"))
    raw = table(spark, sf_dir, "aspect_sentiment_raw").where("parse_status = 'SUCCESS'").groupBy("run_id").agg(F.count_distinct("sentence_id").alias("n_success"))
    valid = table(spark, sf_dir, "aspect_sentiment_valid")
    v = valid.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_aspects"), F.count_if(F.col("validity_label") == "VALID").alias("n_valid"), F.count_distinct(F.when(F.col("validity_label") == "VALID", F.col("sentence_id"))).alias("n_valid_sentences"))
    return reports.coverage_metrics(s.join(raw, "run_id", "left").join(v, "run_id", "left").fillna(0))


def r10_metric_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as shown: shares in per cent, others with four places."""
    m = a24_coverage_metrics(spark, sf_dir)
    return m.select("run_id", "metric_name", reports.shown_metric(F.col("metric_name"), F.col("metric_value")).alias("shown"))


def o04_ordered_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in the order of their names within a run, with their place."""
    return numbered(a24_coverage_metrics(spark, sf_dir), ["run_id"], ["metric_name"], "place").select("run_id", "place", "metric_name", "metric_value")


def x25_shown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with thousands separators, as the report shows them."""
    counts = table(spark, sf_dir, "review_sentences").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("run_id", reports.thousands(F.col("n")).alias("shown"), reports.thousands(F.col("n") * 1000).alias("shown_thousandfold"))


def r09_failure_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per sentence, valid opinions per candidate, and noise per valid opinion."""
    sentences = table(spark, sf_dir, "review_sentences").groupBy("run_id", "sentence_id").agg(F.min("target_sentence").alias("target_sentence"))
    s = opinion.score_sentences(sentences).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("is_candidate").alias("n_candidates"))
    label = lambda name: F.count_if(F.col("validity_label") == name).alias(f"n_{name.lower()}")
    v = table(spark, sf_dir, "aspect_sentiment_valid").groupBy("run_id").agg(label("VALID"), label("NOISE"))
    return reports.failure_ratios(s.join(v, "run_id", "left").fillna(0))


def r07_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a report in one row per run: reviews, sentences, candidates, valid opinions, clusters, noise."""
    sentences = table(spark, sf_dir, "review_sentences").groupBy("run_id", "sentence_id").agg(F.min("target_sentence").alias("target_sentence"), F.min("review_pk").alias("review_pk"))
    s = opinion.score_sentences(sentences).groupBy("run_id").agg(F.count_distinct("review_pk").alias("n_reviews"), F.count(F.lit(1)).alias("n_sentences"), F.count_if("is_candidate").alias("n_candidates"))
    v = table(spark, sf_dir, "aspect_sentiment_valid").groupBy("run_id").agg(F.count_if(F.col("validity_label") == "VALID").alias("n_valid"))
    c = reports.export_summary(_clustered(spark, sf_dir)).select("run_id", "n_clusters", "n_noise")
    return s.join(v, "run_id", "left").join(c, "run_id", "left").fillna(0)


def x22_config_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier of a clustering configuration: its fields as JSON in the order of their names, on every run."""
    config = sinks.config_id({"method": "hdbscan", "min_samples": 3, "aspect": {"threshold": 0.85, "by": "cosine"}})
    return table(spark, sf_dir, "cluster_stats").select("run_id").distinct().withColumn("clustering_config_id", F.lit(config))


def x23_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspects as parts of file names."""
    name = F.substring(F.regexp_replace("aspect_norm", r"[^\p{L}\p{N}_-]", "_"), 1, 50)
    return table(spark, sf_dir, "cluster_stats").where("aspect_norm is not null").select("aspect_norm", name.alias("file_name")).distinct()


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.clusters_once(table(spark, sf_dir, "cluster_stats"))


def a07_cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality of each run's clusters with a confidence."""
    columns = ("cluster_confidence", "separation_ratio", "cohesion", "sentiment_consistency")
    s = _stats(spark, sf_dir).where("cluster_confidence is not null")
    return s.groupBy("run_id").agg(F.count_distinct(F.when(F.col("cluster_id") != "noise", F.col("cluster_id"))).alias("n_clusters"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in columns])


def f15_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences listed as representatives, by explosion of the lists and one join."""
    return reports.representatives(_stats(spark, sf_dir)).join(table(spark, sf_dir, "review_sentences").select("run_id", "sentence_id").distinct(), ["run_id", "sentence_id"], "left_semi")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cluster_samples(_stats(spark, sf_dir), table(spark, sf_dir, "review_sentences"), table(spark, sf_dir, "aspect_sentiment_valid"))


def j05_cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select(*KEYS, "sample_no", "sentence_id", "sample_aspect", "issue_norm", F.substring("target_sentence", 1, reports.QUOTE).alias("quote"))


def o02_largest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 largest clusters."""
    return _stats(spark, sf_dir).select(*KEYS, "cluster_size").orderBy(F.desc_nulls_last("cluster_size"), *KEYS).limit(50)


def o03_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_rows(table(spark, sf_dir, "cluster_reports"), _stats(spark, sf_dir)).select(*KEYS, "report_no", "priority", "cluster_size", "neg_ratio", "cluster_name")


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.insights(_stats(spark, sf_dir), _samples(spark, sf_dir))


def r02_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, summaries, priorities and first actions of all clusters."""
    return _insights(spark, sf_dir).drop("evidence_items", "action_items")


def r04_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of all clusters, one row per item."""
    return _insights(spark, sf_dir).select(*KEYS, F.posexplode("evidence_items").alias("item_no", "e")).select(*KEYS, "item_no", "e.*")


def r05_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of all clusters, one row per item."""
    return _insights(spark, sf_dir).select(*KEYS, F.posexplode("action_items").alias("item_no", "a")).select(*KEYS, "item_no", "a.*")


def l07_repaired_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of the stored reports, whatever form the model gave them."""
    keys, names = ["run_id", "cluster_id", "aspect_norm"], ("owner_team", "urgency")
    stored = table(spark, sf_dir, "cluster_reports").select(*keys, "action_items").distinct()
    listed = flatten_nested(stored, "action_items", keys, root_list="action_items", fields=("action", "text", "suggestion", *names), with_value=True).where("list_name = 'action_items'")
    return reports.repaired_items(listed, keys, names, "action", ("text", "suggestion"))


def l10_fallback_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain insights of all clusters, as they stand in where a model fails."""
    rows = reports.fallback_insights(_stats(spark, sf_dir), _samples(spark, sf_dir))
    return rows.select(*KEYS, "cluster_name", "summary", "priority", "confidence", F.size("evidence_items").alias("n_evidence"), F.col("action_items")[0]["action"].alias("action"))


def l11_sample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all clusters as the text of a prompt."""
    more = first_per(table(spark, sf_dir, "aspect_sentiment_valid"), ["run_id", "sentence_id", "aspect_norm", "issue_norm"], [F.col("sentiment").asc_nulls_last()]).select("run_id", "sentence_id", F.col("aspect_norm").alias("sample_aspect"), "issue_norm", "sentiment")
    votes = table(spark, sf_dir, "review_sentences").groupBy("run_id", "sentence_id").agg(F.max("helpful_vote").alias("helpful_vote"))
    samples = _samples(spark, sf_dir).join(more, ["run_id", "sentence_id", "sample_aspect", "issue_norm"], "left").join(votes, ["run_id", "sentence_id"], "left")
    return reports.sample_blocks(samples, KEYS)


def l09_model_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence and priority where the model gave none."""
    s = _stats(spark, sf_dir).where("cluster_size is not null and neg_ratio is not null")
    return s.select(*KEYS, reports.default_confidence(F.col("cluster_size")).alias("confidence"), reports.fallback_priority(F.col("cluster_size"), F.col("neg_ratio")).alias("priority"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered rows: every valid opinion with the first cluster of its aspect that its sentence represents; all others are noise."""
    heads = reports.representatives(_stats(spark, sf_dir)).groupBy("run_id", "aspect_norm", "sentence_id").agg(F.min("cluster_id").alias("cluster_id"))
    rows = table(spark, sf_dir, "aspect_sentiment_valid").where("validity_label = 'VALID'").select("run_id", "aspect_norm", "sentence_id", "issue_norm", "sentiment").distinct()
    cluster, text = F.coalesce("cluster_id", F.lit("noise")), reports.cluster_key_text(F.col("aspect_norm"), F.col("issue_norm"))
    return rows.join(heads, ["run_id", "aspect_norm", "sentence_id"], "left").select("run_id", "aspect_norm", cluster.alias("cluster_id"), "sentence_id", "issue_norm", "sentiment", text.alias("cluster_key_text"), F.col("cluster_id").isNull().alias("is_noise"))


def s18_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export rows of all clustered opinions, in order."""
    return numbered(reports.export_rows(_clustered(spark, sf_dir), _stats(spark, sf_dir), table(spark, sf_dir, "cluster_reports"), table(spark, sf_dir, "review_sentences")), ["run_id"], reports.export_order(), "row_no").select("run_id", "row_no", *reports.EXPORT_COLUMNS)


def s19_export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, clusters, noise and aspects of each run's export."""
    return reports.export_summary(_clustered(spark, sf_dir))


def s16_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable synonym entries, trimmed and in lower case; of equal originals the last normalised name in order counts."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")).alias(c)
    rows = table(spark, sf_dir, "aspect_synonyms").select(clean("original"), clean("normalized")).where("original <> '' and normalized <> ''")
    return rows.groupBy("original").agg(F.max("normalized").alias("normalized"))


def _as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a run log: users are runs, types are steps."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("step_name"), F.col("event_id").cast("string").alias("state"), F.col("value").alias("output_rows"), F.lit(None).cast("string").alias("error"), F.col("ts").alias("logged_at"))


def s11_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state of every step of every run from an append-only log."""
    return sinks.latest_states(_as_log(spark, sf_dir)).select("run_id", "step_name", "state", "output_rows")


def s13_cleaned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after some steps of one run were cleaned, counted by step."""
    log = _as_log(spark, sf_dir)
    return sinks.without_steps(log, "7", ["click", "view"]).groupBy("step_name").agg(F.count(F.lit(1)).alias("n_events"))


def j03_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join whose right side is filtered before it meets: customers with their urgent orders."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_totalprice")
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_rows"), F.count("o_custkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def s05_parameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read with named parameters."""
    text = "SELECT s_nationkey, count(*) AS n_suppliers FROM {suppliers} WHERE s_acctbal >= :least GROUP BY s_nationkey"
    return spark.sql(text, args={"least": 1000.0}, suppliers=table(spark, sf_dir, "supplier"))


QUERIES = {
    f.__name__: f
    for f in (
        w01_latest_extractions, w02_first_opinions, a01_run_counts, a04_duplicate_opinions, a05_aspect_repeats, a06_busy_sentences, a08_products, a24_coverage_metrics, r10_metric_display, o04_ordered_metrics, x25_shown_counts, r09_failure_ratios, r07_report_counts, x22_config_ids, x23_file_names,
        a07_cluster_means, f15_representatives, j05_cluster_samples, o02_largest_clusters, o03_report_rows, r02_insights, r04_evidence, r05_actions, l07_repaired_actions, l10_fallback_insights, l11_sample_blocks, l09_model_defaults, s18_export, s19_export_summary, s16_taxonomy,
        s11_run_log, s13_cleaned_log, j03_open_orders, s05_parameterised,
    )
}

_STATS = """stats AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, aspect_norm, cluster_id ORDER BY created_at, cluster_size DESC NULLS LAST, neg_ratio NULLS LAST, representative_sentence_ids NULLS LAST) AS k FROM cluster_stats) WHERE k = 1
)"""
_REPS = """reps AS (
  SELECT * FROM (SELECT run_id, aspect_norm, cluster_id, CAST(i - 1 AS INT) AS position, ids[i] AS sentence_id
    FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT *, CAST(CAST(representative_sentence_ids AS JSON) AS VARCHAR[]) AS ids FROM stats))) WHERE sentence_id IS NOT NULL
)"""
_CLUSTERED = """clustered AS (
  SELECT run_id, aspect_norm, coalesce(cluster_id, 'noise') AS cluster_id, sentence_id, issue_norm, sentiment, cluster_id IS NULL AS is_noise, 'Aspect: ' || coalesce(aspect_norm, '') || chr(10) || 'Issue: ' || coalesce(issue_norm, '') AS cluster_key_text
  FROM (SELECT DISTINCT run_id, aspect_norm, sentence_id, issue_norm, sentiment FROM aspect_sentiment_valid WHERE validity_label = 'VALID')
  LEFT JOIN (SELECT run_id, aspect_norm, sentence_id, min(cluster_id) AS cluster_id FROM reps GROUP BY 1, 2, 3) USING (run_id, aspect_norm, sentence_id)
)"""
_ONE_LINE = "translate(coalesce({}, ''), chr(10) || chr(13), '  ')"
_SAMPLES = """samples AS (
  SELECT * FROM (
    SELECT r.*, s.target_sentence, sample_aspect, issue_norm, CAST(row_number() OVER (PARTITION BY r.run_id, aspect_norm, cluster_id ORDER BY position, sample_aspect NULLS LAST, issue_norm NULLS LAST) AS INT) AS sample_no
    FROM reps r JOIN (SELECT run_id, sentence_id, min(target_sentence) AS target_sentence FROM review_sentences GROUP BY 1, 2) s ON r.run_id = s.run_id AND r.sentence_id = s.sentence_id
    JOIN (SELECT DISTINCT run_id, sentence_id, aspect_norm AS sample_aspect, issue_norm FROM aspect_sentiment_valid) v ON r.run_id = v.run_id AND r.sentence_id = v.sentence_id
  ) WHERE sample_no <= 20
)"""
_SIZE, _NEG = "coalesce(cluster_size, 0)", "coalesce(neg_ratio, 0)"
_PRIORITY = f"CASE WHEN {_SIZE} * {_NEG} > 20 OR ({_SIZE} > 50 AND {_NEG} > 0.7) THEN 'high' WHEN {_SIZE} * {_NEG} > 10 OR ({_SIZE} > 20 AND {_NEG} > 0.5) THEN 'medium' ELSE 'low' END"
_H, _A, _S, _C, _E, _M, _L, _N = (q(x) for x in reports.SUMMARY)


def _rule(index: int) -> str:
    tests = " ".join(f"WHEN contains(lower(aspect_norm), {q(r[0])}) OR contains({q(r[0])}, lower(aspect_norm)) THEN {q(r[index])}" for r in reports.ACTIONS)
    return f"CASE {tests} ELSE {q(reports.ACTIONS[-1][index])} END"


_METRICS = (
    "WITH stored AS (SELECT run_id, sentence_id, min(target_sentence) AS target_sentence FROM review_sentences GROUP BY 1, 2), "
    + scored("stored", "scored")
    + """,
counts AS (
  SELECT s.run_id, n_sentences, n_candidates, coalesce(n_success, 0) AS n_success, coalesce(n_aspects, 0) AS n_aspects, coalesce(n_valid, 0) AS n_valid, coalesce(n_valid_sentences, 0) AS n_valid_sentences
  FROM (SELECT run_id, count(*) AS n_sentences, count(*) FILTER (WHERE is_candidate) AS n_candidates FROM scored GROUP BY 1) s
  LEFT JOIN (SELECT run_id, count(DISTINCT sentence_id) AS n_success FROM aspect_sentiment_raw WHERE parse_status = 'SUCCESS' GROUP BY 1) r ON r.run_id = s.run_id
  LEFT JOIN (SELECT run_id, count(*) AS n_aspects, count(*) FILTER (WHERE validity_label = 'VALID') AS n_valid, count(DISTINCT CASE WHEN validity_label = 'VALID' THEN sentence_id END) AS n_valid_sentences FROM aspect_sentiment_valid GROUP BY 1) v ON v.run_id = s.run_id
), metrics AS (
  SELECT run_id, 'candidate_coverage' AS metric_name, round(CASE WHEN n_sentences > 0 THEN n_candidates / CAST(n_sentences AS DOUBLE) ELSE 0 END, 6) AS metric_value, 'overall' AS metric_scope FROM counts
  UNION ALL SELECT run_id, 'extraction_success_rate', round(CASE WHEN n_candidates > 0 THEN n_success / CAST(n_candidates AS DOUBLE) ELSE 0 END, 6), 'overall' FROM counts
  UNION ALL SELECT run_id, 'valid_rate', round(least(1.0, CASE WHEN n_aspects > 0 THEN n_valid / CAST(n_aspects AS DOUBLE) ELSE 0 END), 6), 'overall' FROM counts
  UNION ALL SELECT run_id, 'valid_sentence_rate', round(CASE WHEN n_success > 0 THEN n_valid_sentences / CAST(n_success AS DOUBLE) ELSE 0 END, 6), 'overall' FROM counts
)
"""
)
_PCT = "printf('%.1f', round({} * 100, 1)) || '%'"
_FMT = "coalesce(printf('%.{1}f', round({0}, {1})), '')"

ORACLES = {
    "w01_latest_extractions": """SELECT run_id, sentence_id, retry_count, llm_model, prompt_version FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sentence_id
      ORDER BY created_at DESC, retry_count DESC, llm_model NULLS LAST, prompt_version NULLS LAST, llm_output NULLS LAST) AS k FROM aspect_sentiment_raw WHERE parse_status = 'SUCCESS') WHERE k = 1""",
    "w02_first_opinions": """SELECT run_id, sentence_id, aspect_raw, issue_norm, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sentence_id, aspect_raw
      ORDER BY created_at DESC, issue_norm NULLS LAST, sentiment NULLS LAST, sentiment_score NULLS LAST, evidence_text NULLS LAST) AS k FROM aspect_sentiment_valid) WHERE k = 1""",
    "a01_run_counts": """SELECT run_id, count(*) AS n_records, count(DISTINCT sentence_id) AS n_sentences, count(*) FILTER (WHERE validity_label = 'VALID') AS n_valid, count(*) FILTER (WHERE validity_label = 'NOISE') AS n_noise,
      count(*) FILTER (WHERE validity_label = 'INVALID') AS n_invalid, round(avg(sentiment_score), 6) AS mean_score FROM aspect_sentiment_valid GROUP BY 1""",
    "a04_duplicate_opinions": "SELECT run_id, sentence_id, aspect_norm, issue_norm, count(*) AS n FROM aspect_sentiment_valid WHERE validity_label = 'VALID' GROUP BY 1, 2, 3, 4 HAVING count(*) > 1 ORDER BY n DESC, 1, 2, 3, 4 LIMIT 10",
    "a05_aspect_repeats": """SELECT run_id, sentence_id, aspect_norm, count(*) AS n, count(DISTINCT issue_norm) AS n_issues, CASE WHEN count(*) = count(DISTINCT issue_norm) THEN 'normal' ELSE 'duplicate' END AS verdict
      FROM aspect_sentiment_valid WHERE validity_label = 'VALID' GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "a06_busy_sentences": "SELECT run_id, sentence_id, count(*) AS n FROM aspect_sentiment_valid WHERE validity_label = 'VALID' GROUP BY 1, 2 HAVING count(*) > 10",
    "a08_products": "SELECT DISTINCT run_id, parent_asin FROM review_sentences",
    "a24_coverage_metrics": _METRICS + "SELECT * FROM metrics",
    "r10_metric_display": _METRICS + "SELECT run_id, metric_name, CASE WHEN contains(metric_name, 'coverage') OR contains(metric_name, 'rate') THEN printf('%.2f', round(metric_value * 100, 2)) || '%' ELSE printf('%.4f', metric_value) END AS shown FROM metrics",
    "o04_ordered_metrics": _METRICS + "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY metric_name) AS place, metric_name, metric_value FROM metrics",
    "x25_shown_counts": "SELECT run_id, format('{:,}', count(*)) AS shown, format('{:,}', count(*) * 1000) AS shown_thousandfold FROM review_sentences GROUP BY 1",
    "r09_failure_ratios": _METRICS
    + """SELECT c.run_id, round(CASE WHEN n_sentences > 0 THEN n_candidates / CAST(n_sentences AS DOUBLE) ELSE 0 END, 6) AS candidate_rate, round(CASE WHEN n_candidates > 0 THEN n_valid / CAST(n_candidates AS DOUBLE) ELSE 0 END, 6) AS valid_per_candidate,
      round(CASE WHEN n_valid > 0 THEN coalesce(n_noise, 0) / CAST(n_valid AS DOUBLE) ELSE 0 END, 6) AS noise_rate FROM counts c LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE validity_label = 'NOISE') AS n_noise FROM aspect_sentiment_valid GROUP BY 1) n ON n.run_id = c.run_id""",
    "r07_report_counts": _METRICS.rstrip()
    + f""", {_STATS}, {_REPS}, {_CLUSTERED}
      SELECT c.run_id, n_reviews, n_sentences, n_candidates, n_valid, coalesce(n_clusters, 0) AS n_clusters, coalesce(n_noise, 0) AS n_noise FROM counts c
      JOIN (SELECT run_id, count(DISTINCT pk) AS n_reviews FROM (SELECT run_id, sentence_id, min(review_pk) AS pk FROM review_sentences GROUP BY 1, 2) GROUP BY 1) r ON r.run_id = c.run_id
      LEFT JOIN (SELECT run_id, count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> 'noise') AS n_clusters, count(*) FILTER (WHERE is_noise) AS n_noise FROM clustered GROUP BY 1) k ON k.run_id = c.run_id""",
    "x22_config_ids": """SELECT DISTINCT run_id, '{"aspect": {"by": "cosine", "threshold": 0.85}, "method": "hdbscan", "min_samples": 3}' AS clustering_config_id FROM cluster_stats""",
    "x23_file_names": "SELECT DISTINCT aspect_norm, substring(regexp_replace(aspect_norm, '[^\\pL\\pN_-]', '_', 'g'), 1, 50) AS file_name FROM cluster_stats WHERE aspect_norm IS NOT NULL",
    "a07_cluster_means": f"""WITH {_STATS} SELECT run_id, count(DISTINCT CASE WHEN cluster_id <> 'noise' THEN cluster_id END) AS n_clusters, round(avg(cluster_confidence), 6) AS mean_cluster_confidence,
      round(avg(separation_ratio), 6) AS mean_separation_ratio, round(avg(cohesion), 6) AS mean_cohesion, round(avg(sentiment_consistency), 6) AS mean_sentiment_consistency FROM stats WHERE cluster_confidence IS NOT NULL GROUP BY 1""",
    "f15_representatives": f"WITH {_STATS}, {_REPS} SELECT * FROM reps r WHERE EXISTS (SELECT 1 FROM review_sentences s WHERE s.run_id = r.run_id AND s.sentence_id = r.sentence_id)",
    "j05_cluster_samples": f"WITH {_STATS}, {_REPS}, {_SAMPLES} SELECT run_id, aspect_norm, cluster_id, sample_no, sentence_id, sample_aspect, issue_norm, substring(target_sentence, 1, 200) AS quote FROM samples",
    "o02_largest_clusters": f"WITH {_STATS} SELECT run_id, aspect_norm, cluster_id, cluster_size FROM stats ORDER BY cluster_size DESC NULLS LAST, 1, 2, 3 LIMIT 50",
    "o03_report_rows": f"""WITH {_STATS}, r AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, aspect_norm, cluster_id ORDER BY created_at, priority NULLS LAST, cluster_name NULLS LAST, confidence NULLS LAST) AS k FROM cluster_reports) WHERE k = 1)
      SELECT * FROM (SELECT r.run_id, r.aspect_norm, r.cluster_id, CAST(row_number() OVER (PARTITION BY r.run_id ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, coalesce(cluster_size, 0) DESC, r.cluster_id, r.aspect_norm) AS INT) AS report_no,
        priority, cluster_size, neg_ratio, cluster_name FROM r LEFT JOIN stats s ON r.run_id = s.run_id AND r.aspect_norm = s.aspect_norm AND r.cluster_id = s.cluster_id) WHERE report_no <= 20""",
    "r02_insights": f"""WITH {_STATS}, {_REPS}, {_SAMPLES}, tokens AS (
        SELECT run_id, aspect_norm, cluster_id, sample_no, i AS token_no, ws[i] AS token FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (
          SELECT *, (list_filter(regexp_split_to_array(lower(coalesce(issue_norm, '')), '\\s+'), lambda w: w <> ''))[1:3] AS ws FROM samples))
      ), top AS (
        SELECT * FROM (SELECT run_id, aspect_norm, cluster_id, token, row_number() OVER (PARTITION BY run_id, aspect_norm, cluster_id ORDER BY n DESC, seen) AS k
          FROM (SELECT run_id, aspect_norm, cluster_id, token, count(*) AS n, min(sample_no * 10 + token_no) AS seen FROM tokens GROUP BY ALL)) WHERE k = 1
      ), early AS (
        SELECT run_id, aspect_norm, cluster_id, array_to_string((list(issue_norm ORDER BY sample_no) FILTER (issue_norm <> ''))[1:3], ', ') AS terms FROM samples WHERE sample_no <= 5 GROUP BY ALL
      )
      SELECT s.run_id, s.aspect_norm, s.cluster_id, s.aspect_norm || coalesce(': ' || token, ' issue cluster') AS cluster_name,
        {_H} || s.aspect_norm || {_A} || coalesce(nullif(terms, ''), {_N}) || {_S} || {_PCT.format(_NEG)} || {_C} || CAST({_SIZE} AS VARCHAR) || {_E} || CASE WHEN {_NEG} > 0.7 THEN {_M} WHEN {_NEG} < 0.3 THEN {_L} ELSE '' END AS summary,
        {_PRIORITY} AS priority,
        CASE {_PRIORITY} WHEN 'high' THEN '规模大(' || CAST({_SIZE} AS VARCHAR) || ')且负面率高(' || {_PCT.format(_NEG)} || ')' WHEN 'medium' THEN '规模中等(' || CAST({_SIZE} AS VARCHAR) || ')，负面率' || {_PCT.format(_NEG)}
          ELSE '规模较小(' || CAST({_SIZE} AS VARCHAR) || ')或负面率较低(' || {_PCT.format(_NEG)} || ')' END AS priority_rationale,
        round(least(1.0, 0.7 + CASE WHEN {_SIZE} > 20 THEN 0.1 WHEN {_SIZE} > 10 THEN 0.05 ELSE 0 END + CASE WHEN {_NEG} > 0.8 OR {_NEG} < 0.2 THEN 0.1 ELSE 0 END)::DOUBLE, 4) AS confidence,
        {_rule(1).replace("aspect_norm", "s.aspect_norm")} AS action, {_rule(2).replace("aspect_norm", "s.aspect_norm")} AS owner_team,
        CASE WHEN {_NEG} > 0.7 THEN 'high' WHEN {_NEG} > 0.5 THEN 'medium' ELSE 'low' END AS urgency, CAST(1 + CASE WHEN {_NEG} > 0.7 THEN 1 ELSE 0 END AS INT) AS n_actions
      FROM stats s LEFT JOIN top t ON s.run_id = t.run_id AND s.aspect_norm = t.aspect_norm AND s.cluster_id = t.cluster_id LEFT JOIN early e ON s.run_id = e.run_id AND s.aspect_norm = e.aspect_norm AND s.cluster_id = e.cluster_id""",
    "r04_evidence": f"WITH {_STATS}, {_REPS}, {_SAMPLES} SELECT run_id, aspect_norm, cluster_id, sample_no - 1 AS item_no, sentence_id, substring(target_sentence, 1, 200) AS quote, {q(reports.REPRESENTATIVE)} AS why_representative FROM samples WHERE sample_no <= 5",
    "r05_actions": f"""WITH {_STATS}, n AS (SELECT *, CASE WHEN {_NEG} > 0.7 THEN 'high' WHEN {_NEG} > 0.5 THEN 'medium' ELSE 'low' END AS u FROM stats)
      SELECT run_id, aspect_norm, cluster_id, CAST(0 AS INT) AS item_no, {_rule(1)} AS action, {_rule(2)} AS owner_team, {_rule(3)} AS expected_impact, {_rule(4)} AS validation_plan, u AS urgency FROM n
      UNION ALL SELECT run_id, aspect_norm, cluster_id, 1, {", ".join(map(q, reports.URGENT_ACTION))}, 'high' FROM n WHERE {_NEG} > 0.7""",
    "l07_repaired_actions": f"""WITH stored AS (SELECT DISTINCT 'r' AS source_table, run_id, aspect_norm || chr(9) || cluster_id AS parent_key, {decoded_json("action_items")} AS a FROM cluster_reports),
      items AS ({list_rows("stored", "a", "action_items")}),
      texts AS (SELECT *, CASE WHEN json_type(item) = 'OBJECT' THEN coalesce(nullif(json_extract_string(item, '$.action'), ''), nullif(json_extract_string(item, '$.text'), ''), nullif(json_extract_string(item, '$.suggestion'), ''))
        WHEN json_type(item) <> 'ARRAY' THEN nullif(json_extract_string(item, '$'), '') END AS action FROM items)
      SELECT run_id, split_part(parent_key, chr(9), 2) AS cluster_id, split_part(parent_key, chr(9), 1) AS aspect_norm, CAST(item_path AS INT) AS ordinal, action, json_extract_string(item, '$.owner_team') AS owner_team, json_extract_string(item, '$.urgency') AS urgency
      FROM texts WHERE action IS NOT NULL""",
    "l10_fallback_insights": f"""WITH {_STATS}, {_REPS}, {_SAMPLES}, p AS (SELECT *, {_SIZE} AS z, {_NEG} AS g FROM stats), n AS (SELECT run_id, aspect_norm, cluster_id, count(*) AS c FROM samples WHERE sample_no <= 5 GROUP BY ALL)
      SELECT p.run_id, p.aspect_norm, p.cluster_id, p.aspect_norm || ' issue cluster ' || p.cluster_id AS cluster_name,
        'Cluster contains ' || CAST(z AS VARCHAR) || ' issues related to ' || p.aspect_norm || '. Negative sentiment ratio: ' || printf('%.2f', round(g * 100, 2)) || '%.' AS summary,
        CASE WHEN z < 10 THEN 'low' WHEN g > 0.5 AND z > 20 THEN 'high' ELSE 'medium' END AS priority, 0.5::DOUBLE AS confidence, CAST(coalesce(c, 0) AS INT) AS n_evidence, 'Investigate ' || p.aspect_norm || ' issues' AS action
      FROM p LEFT JOIN n ON p.run_id = n.run_id AND p.aspect_norm = n.aspect_norm AND p.cluster_id = n.cluster_id""",
    "l11_sample_blocks": f"""WITH {_STATS}, {_REPS}, {_SAMPLES}, more AS (SELECT run_id, sentence_id, aspect_norm AS sample_aspect, issue_norm, min(sentiment) AS sentiment FROM aspect_sentiment_valid GROUP BY 1, 2, 3, 4),
      votes AS (SELECT run_id, sentence_id, max(helpful_vote) AS helpful_vote FROM review_sentences GROUP BY 1, 2),
      blocks AS (SELECT run_id, aspect_norm, cluster_id, sample_no, '样本' || CAST(sample_no AS VARCHAR) || ':' || chr(10) || '  - sentence_id: ' || sentence_id || chr(10) || '  - 句子: ' || coalesce(target_sentence, '') || chr(10) || '  - 问题: ' || coalesce(issue_norm, '') || chr(10)
        || '  - 情感: ' || coalesce(sentiment, '') || chr(10) || '  - 有用票数: ' || coalesce(CAST(helpful_vote AS VARCHAR), '') || chr(10) AS block
        FROM samples LEFT JOIN more USING (run_id, sentence_id, sample_aspect, issue_norm) LEFT JOIN votes USING (run_id, sentence_id))
      SELECT run_id, aspect_norm, cluster_id, string_agg(block, chr(10) ORDER BY sample_no) AS samples FROM blocks GROUP BY ALL""",
    "l09_model_defaults": f"""WITH {_STATS} SELECT run_id, aspect_norm, cluster_id, CASE WHEN cluster_size > 5 THEN 0.8 WHEN cluster_size > 2 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence,
      CASE WHEN cluster_size < 10 THEN 'low' WHEN neg_ratio > 0.5 AND cluster_size > 20 THEN 'high' ELSE 'medium' END AS priority FROM stats WHERE cluster_size IS NOT NULL AND neg_ratio IS NOT NULL""",
    "s18_export": f"""WITH {_STATS}, {_REPS}, {_CLUSTERED},
      r AS (SELECT run_id, aspect_norm, cluster_id, cluster_name, summary, priority, confidence AS insight_confidence FROM (SELECT *, row_number() OVER (PARTITION BY run_id, aspect_norm, cluster_id ORDER BY created_at, cluster_name NULLS LAST) AS k FROM cluster_reports) WHERE k = 1),
      t AS (SELECT run_id, sentence_id, review_pk, parent_asin, unix_ts, rating, verified_purchase, helpful_vote, sentence_index, target_sentence, prev_sentence, next_sentence, context_text
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sentence_id ORDER BY created_at, target_sentence NULLS LAST, context_text NULLS LAST) AS k FROM review_sentences) WHERE k = 1),
      z AS (SELECT run_id, aspect_norm, cluster_id, cluster_size, neg_ratio, intra_cluster_distance, inter_cluster_distance, separation_ratio, cohesion, cluster_confidence, sentiment_consistency, representative_sentence_ids FROM stats)
      SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY aspect_norm, CASE WHEN cluster_id = 'noise' THEN 1 ELSE 0 END, CASE WHEN cluster_id = 'noise' THEN 'zzz_noise' ELSE lpad(cluster_id, 10, '0') END, unix_ts DESC NULLS LAST, sentence_id, coalesce(issue_norm, ''), coalesce(sentiment, '')) AS row_no,
        aspect_norm, cluster_id, coalesce(cluster_name, '') AS cluster_name, CASE WHEN is_noise THEN '是' ELSE '否' END AS is_noise, coalesce(issue_norm, '') AS issue_norm, coalesce(sentiment, '') AS sentiment, cluster_key_text, coalesce(priority, '') AS priority,
        coalesce(CAST(cluster_size AS VARCHAR), '') AS cluster_size, {_FMT.format("neg_ratio", 4)} AS neg_ratio, {_FMT.format("intra_cluster_distance", 4)} AS intra_cluster_distance, {_FMT.format("inter_cluster_distance", 4)} AS inter_cluster_distance,
        {_FMT.format("separation_ratio", 4)} AS separation_ratio, {_FMT.format("cohesion", 4)} AS cohesion, {_FMT.format("cluster_confidence", 4)} AS cluster_confidence, {_FMT.format("sentiment_consistency", 4)} AS sentiment_consistency, {_FMT.format("insight_confidence", 4)} AS insight_confidence,
        coalesce(representative_sentence_ids, '') AS representative_sentence_ids, coalesce(summary, '') AS summary, sentence_id, coalesce(review_pk, '') AS review_pk, coalesce(parent_asin, '') AS parent_asin, coalesce(CAST(unix_ts AS VARCHAR), '') AS timestamp,
        {_FMT.format("rating", 1)} AS rating, CASE WHEN verified_purchase THEN '是' WHEN verified_purchase IS NOT NULL THEN '否' ELSE '' END AS verified_purchase, coalesce(CAST(helpful_vote AS VARCHAR), '') AS helpful_vote, coalesce(CAST(sentence_index AS VARCHAR), '') AS sentence_index,
        {_ONE_LINE.format("target_sentence")} AS target_sentence, {_ONE_LINE.format("prev_sentence")} AS prev_sentence, {_ONE_LINE.format("next_sentence")} AS next_sentence, {_ONE_LINE.format("context_text")} AS context_text
      FROM clustered LEFT JOIN z USING (run_id, aspect_norm, cluster_id) LEFT JOIN r USING (run_id, aspect_norm, cluster_id) LEFT JOIN t USING (run_id, sentence_id)""",
    "s19_export_summary": f"WITH {_STATS}, {_REPS}, {_CLUSTERED} SELECT run_id, count(*) AS n_records, count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> 'noise') AS n_clusters, count(*) FILTER (WHERE is_noise) AS n_noise, string_agg(DISTINCT nullif(aspect_norm, ''), ',' ORDER BY nullif(aspect_norm, '')) AS aspects FROM clustered GROUP BY 1",
    "s16_taxonomy": r"SELECT original, max(normalized) AS normalized FROM (SELECT lower(regexp_replace(original, '^\s+|\s+$', '', 'g')) AS original, lower(regexp_replace(normalized, '^\s+|\s+$', '', 'g')) AS normalized FROM aspect_synonyms) WHERE original <> '' AND normalized <> '' GROUP BY 1",
    "s11_run_log": "SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS step_name, CAST(event_id AS VARCHAR) AS state, value AS output_rows FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS k FROM events) WHERE k = 1",
    "s13_cleaned_log": "SELECT event_type AS step_name, count(*) AS n_events FROM events WHERE NOT (user_id = 7 AND event_type IN ('click', 'view')) GROUP BY 1",
    "j03_open_orders": "SELECT c_mktsegment, count(*) AS n_rows, count(o_custkey) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1",
    "s05_parameterised": "SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_acctbal >= 1000.0 GROUP BY 1",
}
