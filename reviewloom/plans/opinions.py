"""Queries of the lexicon pipeline, from reviews to judged opinions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.plans import filter_above
from reviewloom.functions.text import epoch_seconds, slice_id_of
from reviewloom.operators import extraction, normalize, opinion, selection
from reviewloom.operators.selection import Slice
from reviewloom.plans import opinions_sql
from reviewloom.pipeline import RunConfig, run_pipeline, table_name
from reviewloom.sources.sinks import RunStore
from reviewloom.sources.tables import materialize, table, temporary_folder

SLICE = Slice(first_ts=1_650_000_000, last_ts=1_720_000_000, min_helpful=0)


def _selected(spark: SparkSession, sf_dir: str, wanted: Slice = Slice()) -> DataFrame:
    return selection.select_reviews(table(spark, sf_dir, "reviews"), table(spark, sf_dir, "meta"), wanted)


def s02_review_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with their keys, one per key."""
    return selection.distinct_reviews(table(spark, sf_dir, "reviews")).select("review_pk", "parent_asin", "unix_ts", "rating")


def j01_selected_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice by time and votes, joined with the products."""
    return _selected(spark, sf_dir, SLICE).select("review_pk", "parent_asin", "asin", "user_id", "unix_ts", "rating", "verified_purchase", "helpful_vote", "review_title", "product_title", "main_category")


def x14_epoch_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the reviews in one unit, counted by year."""
    seconds = epoch_seconds(F.col("unix_ts"))
    return table(spark, sf_dir, "reviews").where("unix_ts is not null").groupBy(F.year(F.timestamp_seconds(seconds)).alias("year")).agg(F.count(F.lit(1)).alias("n_reviews"), F.min(seconds).alias("first"), F.max(seconds).alias("last"))


def v02_slice_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the slices by category and product."""
    rows = table(spark, sf_dir, "meta").select("main_category", "parent_asin").distinct()
    return rows.select("main_category", "parent_asin", slice_id_of(F.col("main_category"), F.col("parent_asin"), F.lit("1-2")).alias("data_slice_id"))


def f02_product_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of one product, the one with the smallest name among the most reviewed."""
    counts = table(spark, sf_dir, "reviews").where("parent_asin is not null").groupBy("parent_asin").agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), "parent_asin").first()
    return _selected(spark, sf_dir, Slice(parent_asin=first["parent_asin"] if first else "")).select("review_pk", "parent_asin", "rating", "product_title")


def f01_category_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice by category and verification, counted per product."""
    return _selected(spark, sf_dir, Slice(category="Home", verified=True)).groupBy("parent_asin").agg(F.count(F.lit(1)).alias("n_reviews"))


def o01_first_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of a slice: the feature itself, with a fixed order."""
    return _selected(spark, sf_dir, Slice(limit=100)).select("review_pk", "product_title")


def j08_meta_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened product context of all selected products."""
    return selection.meta_context(_selected(spark, sf_dir), table(spark, sf_dir, "meta"))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = selection.distinct_reviews(table(spark, sf_dir, "reviews"))
    return selection.normalize_reviews(reviews.withColumnsRenamed({"title": "review_title", "text": "review_text"}))


def x03_normalized_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir)


def x04_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.build_sentences(_normalized(spark, sf_dir))


def x04_document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cleaning and splitting over the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("review_pk"), "parent_asin", F.unix_timestamp(F.col("fetched_at").cast("timestamp")).alias("unix_ts"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("string").alias("review_title"), F.col("text").alias("review_text"))
    return selection.build_sentences(selection.normalize_reviews(docs)).select("sentence_id", "target_sentence", "context_text")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinion.score_sentences(selection.build_sentences(_normalized(spark, sf_dir)))


def opinion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("sentence_id", "is_candidate", "filter_reason", "priority_weight")


def opinion_scores_of_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the stored sentences, which still have their final marks."""
    rows = table(spark, sf_dir, "review_sentences").select("target_sentence").where("target_sentence is not null").distinct()
    return opinion.score_sentences(rows).select("target_sentence", "is_candidate", "filter_reason", "priority_weight")


def a22_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy(F.col("priority_weight").cast("int").alias("score")).agg(F.count(F.lit(1)).alias("n_sentences"))


def _opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions of the candidate sentences with product context (right-hand filter before the join)."""
    kept = filter_above(_scored(spark, sf_dir), "is_candidate")
    context = selection.meta_context(table(spark, sf_dir, "reviews"), table(spark, sf_dir, "meta")).select("parent_asin", "product_title", "features_short")
    return kept.join(context, "parent_asin", "left")


def t07_aspect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.ranked_candidates(_opinions(spark, sf_dir))
    return rows.select("sentence_id", "candidate_rank", "text", "stage", F.round("confidence", 4).alias("confidence"))


def t11_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.extract(_opinions(spark, sf_dir))
    return rows.select("sentence_id", "aspect_raw", "sentiment", "sentiment_score", "issue_raw", "evidence_text")


def t12_debug_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What led to every opinion, as JSON."""
    return extraction.extract(_opinions(spark, sf_dir)).select("sentence_id", "aspect_raw", extraction.debug_features().alias("debug_features"))


def _judged(spark: SparkSession, sf_dir: str, fuzzy: bool = False) -> DataFrame:
    rows = materialize(extraction.extract(_opinions(spark, sf_dir)))  # read by the names and by the rows
    names = normalize.normalize_aspects(rows, fuzzy=fuzzy)
    rows = rows.join(names, "aspect_raw").withColumn("issue_norm", F.lower(normalize.strip(F.col("issue_raw"))))
    label = normalize.validity(F.col("aspect_norm"), F.col("issue_norm"))
    return rows.withColumns({"validity_label": label, "quality_flags": normalize.rating_conflict(F.col("rating"), F.col("sentiment"))})


def n16_judged_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged opinions, one per sentence, aspect and issue."""
    keys = ["sentence_id", "aspect_norm", "issue_norm"]
    rows = selection.first_per(_judged(spark, sf_dir), keys, ["candidate_rank"])
    return rows.select(*keys, "sentiment", "sentiment_score", "validity_label", "quality_flags")


def a26_judge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n16_judged_opinions(spark, sf_dir).groupBy("validity_label").agg(F.count(F.lit(1)).alias("n_opinions"))


def n07_normalized_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade without the spelling step over all aspects of the stored opinions."""
    return normalize.normalize_aspects(table(spark, sf_dir, "aspect_sentiment_valid"), fuzzy=False)


def n01_taxonomy_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade without the spelling step over the stored opinions, with the synonyms of the table."""
    synonyms = normalize.synonyms_of(table(spark, sf_dir, "aspect_synonyms"))
    return normalize.normalize_aspects(table(spark, sf_dir, "aspect_sentiment_valid"), synonyms, fuzzy=False)


def n03_fuzzy_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade; SQL has no such similarity."""
    return normalize.normalize_aspects(table(spark, sf_dir, "aspect_sentiment_valid"))


def n11_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, noise and rating conflicts of the stored opinions."""
    rows = table(spark, sf_dir, "aspect_sentiment_valid").select("aspect_norm", "issue_norm", "rating", "sentiment").distinct()
    return rows.select("*", normalize.validity(F.col("aspect_norm"), F.col("issue_norm")).alias("validity"), normalize.rating_conflict(F.col("rating"), F.col("sentiment")).alias("conflict"))


def n12_unfound_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored opinions whose evidence is not in their sentence of the same run."""
    valid = table(spark, sf_dir, "aspect_sentiment_valid").select("run_id", "sentence_id", "aspect_norm", "evidence_text")
    sentences = table(spark, sf_dir, "review_sentences").select("run_id", "sentence_id", "target_sentence").distinct()
    joined = valid.join(sentences, ["run_id", "sentence_id"])
    return joined.where(~normalize.evidence_found(F.col("evidence_text"), F.col("target_sentence"))).select("run_id", "sentence_id", "aspect_norm", F.lit("EVIDENCE_NOT_FOUND").alias("issue_type"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspects that draw the most negative sentiment per product category."""
    rows = _judged(spark, sf_dir).where("validity_label = 'VALID'")
    categories = selection.first_per(table(spark, sf_dir, "meta"), ["parent_asin"], [F.col(c).asc_nulls_last() for c in ("title", "main_category", "description", "details")]).select("parent_asin", "main_category")
    joined = rows.join(categories, "parent_asin", "left")
    negative = F.avg(F.when(F.col("sentiment").isin("negative", "neg"), 1.0).otherwise(0.0))
    return joined.groupBy("main_category", "aspect_norm").agg(F.count(F.lit(1)).alias("n_opinions"), F.round(negative, 6).alias("neg_ratio"))


def s10_run_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from the reviews to its judged opinions, written step by step, and the run's partition read back."""
    folder = temporary_folder(spark, "runs")
    config = RunConfig(fuzzy=False)
    run_pipeline(spark, folder, "run-1", table(spark, sf_dir, "reviews"), table(spark, sf_dir, "meta"), config, last="judge")
    rows = RunStore(spark, folder).read(table_name(config, "aspect_sentiment_valid"), "run-1")
    return rows.select("sentence_id", "parent_asin", "aspect_norm", "issue_norm", "sentiment", "sentiment_score", "evidence_text", "quality_flags")


QUERIES = {
    f.__name__: f
    for f in (s02_review_keys, j01_selected_reviews, x14_epoch_seconds, f01_category_slice, v02_slice_ids, f02_product_slice, o01_first_reviews, j08_meta_context, x03_normalized_reviews, x04_sentences, x04_document_sentences, opinion_scores, opinion_scores_of_stored, a22_score_histogram, t07_aspect_candidates, t11_opinions, t12_debug_features, n16_judged_opinions, a26_judge_counts, n07_normalized_aspects, n01_taxonomy_aspects, n03_fuzzy_aspects, n11_validity, n12_unfound_evidence, s10_run_opinions, flagship)
}
ORACLES = opinions_sql.ORACLES
