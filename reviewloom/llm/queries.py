"""Queries of the text-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.canonical import map_to_entries, reference_entries
from reviewloom.llm.density import density_clusters, typical_members
from reviewloom.llm.format_duplicates import copy_counts, format_duplicates
from reviewloom.llm.leakage import leaked_items, reparameterised_items
from reviewloom.llm.packing import pack_items, packing_faults, token_counts
from reviewloom.llm.quality import document_statistics, not_prose
from reviewloom.llm.sentences import split_sentences
from reviewloom.operators.flatten import flatten_nested
from reviewloom.plans.general import PAYLOAD_FIELDS, successful_payloads
from reviewloom.sources.tables import materialize, table


def typed_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (run_id, value) of the aspects that successful payloads name; NULL and blank ones left out."""
    rows = successful_payloads(table(spark, sf_dir, "aspect_sentiment_raw"))
    listed = flatten_nested(rows, "llm_output", ["run_id"], PAYLOAD_FIELDS, declared=["aspects"], fields=["aspect"]).where("list_name = 'aspects'")
    return listed.where(F.col("aspect").rlike(r"[^\s\p{Z}]")).select("run_id", F.col("aspect").alias("value")).distinct()


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = materialize(typed_aspects(spark, sf_dir))
    entries = reference_entries(table(spark, sf_dir, "aspect_synonyms"))
    return values.join(map_to_entries(materialize(values.select("value").distinct()), entries), "value")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical name of every freely typed aspect, or UNMATCHED."""
    return _mapped(spark, sf_dir).select("run_id", F.col("value").alias("aspect_value"), "normalized")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed aspects that are no form of any entry, with the number of runs that hold them."""
    return _mapped(spark, sf_dir).where("entry is null").groupBy(F.col("value").alias("aspect_value")).agg(F.count(F.lit(1)).alias("n_runs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a run that differ in formatting only."""
    found = format_duplicates(table(spark, sf_dir, "review_sentences"), "run_id", "sentence_id", "target_sentence")
    return found.select(F.col("scope").alias("run_id"), F.col("first_id").alias("first_sentence_id"), F.col("record_id").alias("sentence_id"))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per run and sentence, with the number of its copies."""
    counts = copy_counts(table(spark, sf_dir, "review_sentences"), "run_id", "sentence_id", "target_sentence")
    return counts.select(F.col("scope").alias("run_id"), F.col("first_id").alias("first_sentence_id"), F.col("n_records").alias("n_copies"))


def _valid_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "aspect_sentiment_valid").where("validity_label = 'VALID'").select("run_id", "aspect_norm", "issue_norm")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that report the same fault as a smaller one of their run and aspect."""
    clusters = density_clusters(_valid_issues(spark, sf_dir), ["run_id", "aspect_norm"], "issue_norm")
    return clusters.where("value <> first_value").select("run_id", "aspect_norm", F.col("first_value").alias("first_issue"), F.col("value").alias("issue_norm"))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical members of every group of issues, groups of one included."""
    return typical_members(_valid_issues(spark, sf_dir), ["run_id", "aspect_norm"], "issue_norm").withColumnRenamed("first_value", "first_issue")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every group of issues, groups of one included: values and rows."""
    groups = typical_members(_valid_issues(spark, sf_dir), ["run_id", "aspect_norm"], "issue_norm")
    return groups.where("rank = 1").select("run_id", "aspect_norm", F.col("first_value").alias("first_issue"), "n_values", "n_rows")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of the true sentences in the contexts of first sentences."""
    rows = table(spark, sf_dir, "review_sentences").where("sentence_index = 0").select("run_id", "sentence_id", "context_text").distinct()
    return split_sentences(rows, "context_text", ["run_id", "sentence_id"]).select("run_id", "sentence_id", "start_char").distinct()


def p6_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every target_sentence, which the upstream splitter left joined or cut, with their texts."""
    rows = table(spark, sf_dir, "review_sentences").select("run_id", "sentence_id", "target_sentence").distinct()
    return split_sentences(rows, "target_sentence", ["run_id", "sentence_id"], with_text=True).select("run_id", "sentence_id", "start_char", "sentence").distinct()


def p6_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every context_text, of whatever place in the review, with their texts."""
    rows = table(spark, sf_dir, "review_sentences").select("run_id", "sentence_id", "context_text").distinct()
    return split_sentences(rows, "context_text", ["run_id", "sentence_id"], with_text=True).select("run_id", "sentence_id", "start_char", "sentence").distinct()


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document with their texts."""
    return split_sentences(table(spark, sf_dir, "documents"), "text", ["doc_id"], with_text=True)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece of a document."""
    counts = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack_items(counts).withColumnRenamed("item_id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the filled share of all containers."""
    bins = p8_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("n_tokens"))
    return bins.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("max_tokens"), F.round(F.avg("n_tokens") / 2048, 4).alias("filled_share"))


def p8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tokens, and what is wrong with their containers: nothing."""
    counts = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing_faults(counts, pack_items(counts))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item."""
    return leaked_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text"))


def p9_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item with exchanged numbers, names or units."""
    return reparameterised_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text"))


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "common_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not prose."""
    return not_prose(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "common_words"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, verdict and reasons of every document."""
    return _statistics(spark, sf_dir)


def p10_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of every document: words, lines, and the shares that the problem names."""
    return _statistics(spark, sf_dir).select("doc_id", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_copies, p5_found, p5_clusters, p5_groups, p6_found, p6_targets, p6_contexts, p6_documents, p8_containers, p8_fill, p8_faults, p9_found, p9_variants, p10_found, p10_statistics, p10_numbers)}

from reviewloom.llm.sql import ORACLES  # noqa: E402, F401
