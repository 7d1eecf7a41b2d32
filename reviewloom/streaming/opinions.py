"""The row-local steps over a stream of reviews: an addition, as the batch pipeline has no stream of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import review_pk
from reviewloom.operators.opinion import score_sentences
from reviewloom.operators.selection import build_sentences, normalize_reviews


def scored_sentences(reviews: DataFrame, time: str = "arrived_at", lateness: str = "1 hour") -> DataFrame:
    """Scored sentences of a stream of reviews; repeated reviews within the lateness are dropped, with bounded state.

    reviews: the columns of the reviews table and a time column.
    """
    keyed = reviews.withColumn("review_pk", review_pk(F.col("parent_asin"), F.col("user_id"), F.col("unix_ts"), F.col("title"), F.col("text")))
    once = keyed.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["review_pk"])
    return score_sentences(build_sentences(normalize_reviews(once.withColumnsRenamed({"title": "review_title", "text": "review_text"}))))
