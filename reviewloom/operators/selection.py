"""Selecting a slice of reviews with their products, cleaning them, and splitting them into sentences with context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.plans import filter_above
from reviewloom.functions.text import between_seconds, merged_clean, non_empty, review_pk, split_plain, truncated


class EmptySelection(ValueError):
    """Raised when a slice holds no review."""


@dataclass(frozen=True)
class Slice:
    """Optional conditions of a slice; NULL values never meet a condition. Times are seconds."""

    category: str | None = None
    parent_asin: str | None = None
    first_ts: int | None = None
    last_ts: int | None = None
    verified: bool | None = None
    min_helpful: int | None = None
    limit: int | None = None


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key by an explicit order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def distinct_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with their key, one per key; of several the smallest by the remaining fields."""
    keyed = reviews.withColumn("review_pk", review_pk(F.col("parent_asin"), F.col("user_id"), F.col("unix_ts"), F.col("title"), F.col("text")))
    rest = [F.col(c).asc_nulls_last() for c in ("asin", "rating", "verified_purchase", "helpful_vote", "text")]
    return first_per(keyed, ["review_pk"], rest)


def select_reviews(reviews: DataFrame, meta: DataFrame, wanted: Slice = Slice()) -> DataFrame:
    """Reviews of the slice with product title and category; a product listed twice gives its reviews twice.

    A condition on the category makes the left join an inner one. With a limit, the smallest keys are taken. Product and
    time are part of a review's key, so their conditions come before rows are made distinct and reach the scan; the others
    look at the one row that stands for a key.
    """
    if wanted.parent_asin is not None:
        reviews = reviews.where(F.col("parent_asin") == wanted.parent_asin)
    if wanted.first_ts is not None or wanted.last_ts is not None:
        reviews = reviews.where(between_seconds(F.col("unix_ts"), wanted.first_ts, wanted.last_ts))
    r = distinct_reviews(reviews)
    if wanted.verified is not None:
        r = r.where(F.col("verified_purchase") == F.lit(wanted.verified))
    if wanted.min_helpful is not None:
        r = r.where(F.col("helpful_vote") >= wanted.min_helpful)
    m = meta.select("parent_asin", F.col("title").alias("product_title"), "main_category")
    if wanted.category is not None:
        m = m.where(F.col("main_category") == wanted.category)
    joined = r.withColumnsRenamed({"title": "review_title", "text": "review_text"}).join(m, "parent_asin", "inner" if wanted.category is not None else "left")
    if wanted.limit is not None:
        joined = joined.orderBy("review_pk", F.col("product_title").asc_nulls_last(), F.col("main_category").asc_nulls_last()).limit(wanted.limit)
    return joined


def require_rows(df: DataFrame) -> DataFrame:
    """The same frame, or an error if it is empty."""
    if df.isEmpty():
        raise EmptySelection("no reviews in this slice")
    return df


def meta_context(selected: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per selected product that is known: its first listing by title, with shortened features, description and details."""
    one = first_per(meta, ["parent_asin"], [F.col(c).asc_nulls_last() for c in ("title", "main_category", "description", "details")])
    wanted = selected.select("parent_asin").where("parent_asin is not null").distinct()
    features = truncated(F.concat_ws(", ", F.col("features")))
    return one.join(wanted, "parent_asin", "left_semi").select("parent_asin", F.col("title").alias("product_title"), "main_category", features.alias("features_short"), truncated(F.col("description")).alias("description_short"), truncated(F.col("details")).alias("details_short"))


def normalize_reviews(selected: DataFrame, min_length: int = 10) -> DataFrame:
    """Cleaned text of reviews that keep at least `min_length` characters, with cleaning flags (NULL if none)."""
    out = selected.select("review_pk", "parent_asin", "unix_ts", "rating", merged_clean(F.col("review_title"), F.col("review_text")).alias("clean_text"), F.when(non_empty(F.col("review_title")).isNull(), "no_title").alias("cleaning_flags"))
    return filter_above(out, F.length("clean_text") >= min_length)


def build_sentences(normalized: DataFrame, context_window: int = 1) -> DataFrame:
    """One row per sentence with its id, its neighbours (none if context_window is 0) and the three joined as context."""
    rows = normalized.select("review_pk", "parent_asin", "unix_ts", "rating", split_plain(F.col("clean_text")).alias("s"))
    rows = rows.select("*", F.posexplode("s").alias("sentence_index", "target_sentence"))
    if context_window > 0:
        before = F.when(F.col("sentence_index") > 0, F.try_element_at("s", F.col("sentence_index")))
        after = F.try_element_at("s", F.col("sentence_index") + 2)
    else:
        before = after = F.lit(None).cast("string")
    sentence_id = F.concat("review_pk", F.lit("_"), F.col("sentence_index").cast("string"))
    out = rows.select(sentence_id.alias("sentence_id"), "review_pk", "parent_asin", "unix_ts", "rating", "sentence_index", "target_sentence", before.alias("prev_sentence"), after.alias("next_sentence"))
    return out.withColumn("context_text", F.concat_ws(" ", "prev_sentence", "target_sentence", "next_sentence"))
