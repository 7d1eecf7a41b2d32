"""Queries of the general data-pipeline operators: nested records, skewed keys, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.flatten import flatten_nested
from reviewloom.operators.references import clean_id, orphan_references, orphans_by_period
from reviewloom.operators.skew import balanced_group_agg, fragment_replicate_join
from reviewloom.sources.tables import table

#: Fields that mark the record of an extraction payload inside its wrappers.
PAYLOAD_FIELDS = ("sentence_id", "has_opinion", "aspects", "extraction_warnings")
PAYLOAD_LISTS = ("aspects", "aspects.evidence_spans", "extraction_warnings")
REPORT_LISTS = {"evidence_items": ("evidence_items",), "action_items": ("action_items", "action_items.validation_plan.steps")}
#: Share of all rows from which a key counts as heavy.
HEAVY_SHARE = 0.04


def successful_payloads(raw: DataFrame) -> DataFrame:
    keys = F.concat(F.col("sentence_id"), F.lit("#"), F.col("retry_count").cast("string"))
    return raw.where("parse_status = 'SUCCESS' and llm_output is not null").select("run_id", keys.alias("parent_key"), "llm_output")


def payload_lists(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ()) -> DataFrame:
    rows = successful_payloads(table(spark, sf_dir, "aspect_sentiment_raw"))
    lists = flatten_nested(rows, "llm_output", ["run_id", "parent_key"], PAYLOAD_FIELDS, declared=PAYLOAD_LISTS, fields=fields)
    return lists.withColumn("source_table", F.lit("aspect_sentiment_raw"))


def report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "cluster_reports")
    out = None
    for column, declared in REPORT_LISTS.items():
        rows = reports.select("run_id", F.col("cluster_id").alias("parent_key"), column)
        part = flatten_nested(rows, column, ["run_id", "parent_key"], root_list=column, declared=declared)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("source_table", F.lit("cluster_reports"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list element of the payloads and reports, once."""
    names = [*PAYLOAD_LISTS, *(n for lists in REPORT_LISTS.values() for n in lists)]
    rows = payload_lists(spark, sf_dir).unionByName(report_lists(spark, sf_dir)).where(F.col("list_name").isin(names))
    return rows.select("source_table", "run_id", "parent_key", "list_name", "item_path").distinct()


def p3_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child table of the aspects with its fields as columns; numbers that were written as text are numbers again."""
    text, numbers = ("aspect", "sentiment", "issue", "evidence_text"), ("sentiment_score", "confidence")
    rows = payload_lists(spark, sf_dir, (*text, *numbers)).where("list_name = 'aspects'")
    return rows.select("run_id", "parent_key", "ordinal", *text, *[F.expr(f"try_cast({n} as double)").alias(n) for n in numbers]).distinct()


def p3_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements per list over all runs."""
    return p3_found(spark, sf_dir).groupBy("source_table", "list_name").agg(F.count(F.lit(1)).alias("n_elements"))


P4_SOURCES = {"reviews": ("parent_asin", "rating"), "aspect_sentiment_valid": ("aspect_norm", "sentiment_score")}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least HEAVY_SHARE of the rows, from the counts that the shards of each key add up to."""
    out = None
    for name, (key, _) in P4_SOURCES.items():
        df = table(spark, sf_dir, name).select(key)
        counts = balanced_group_agg(df, key, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n_rows")])
        part = counts.where(F.col("n_rows") >= HEAVY_SHARE * df.count()).select(F.lit(name).alias("source_table"), F.col(key).alias("key_value"))
        out = part if out is None else out.unionByName(part)
    return out


def _key_stats(df: DataFrame, key: str, measure: str) -> DataFrame:
    partial = [F.count(F.lit(1)).alias("n"), F.sum(measure).alias("s"), F.count(measure).alias("c")]
    final = [F.sum("n").alias("n_rows"), F.round(F.sum("s") / F.nullif(F.sum("c"), F.lit(0)), 6).alias(f"mean_{measure}")]
    return balanced_group_agg(df.select(key, measure), key, partial, final)


def p4_review_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and mean rating of every product."""
    return _key_stats(table(spark, sf_dir, "reviews"), "parent_asin", "rating")


def p4_aspect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and mean sentiment score of every aspect."""
    return _key_stats(table(spark, sf_dir, "aspect_sentiment_valid"), "aspect_norm", "sentiment_score")


def p4_category_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews joined with their product's categories on balanced tasks, then counted per category."""
    reviews = table(spark, sf_dir, "reviews").select("parent_asin", "rating")
    meta = table(spark, sf_dir, "meta").select("parent_asin", "main_category").distinct()
    joined = fragment_replicate_join(reviews, meta, "parent_asin", how="left")
    return joined.groupBy("main_category").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("rating"), 6).alias("mean_rating"))


def sentence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["run_id", "cluster_id", "created_at"]
    stats = table(spark, sf_dir, "cluster_stats")
    listed = flatten_nested(stats, "representative_sentence_ids", keys, root_list="ids", fields=["sentence_id"], with_value=True).where("not startswith(value, '[')")
    reports = table(spark, sf_dir, "cluster_reports")
    quoted = flatten_nested(reports, "evidence_items", keys, root_list="evidence_items", fields=["sentence_id"])
    valid = table(spark, sf_dir, "aspect_sentiment_valid")

    def refs(df: DataFrame, name: str, key: str, value: F.Column) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col("run_id").alias("scope"), clean_id(value).alias("id"), F.col(key).alias("ref_key"), "created_at")

    return (
        refs(listed, "cluster_stats", "cluster_id", F.coalesce("sentence_id", "value"))
        .unionByName(refs(quoted, "cluster_reports", "cluster_id", F.col("sentence_id")))
        .unionByName(refs(valid, "aspect_sentiment_valid", "aspect_norm", F.col("sentence_id")))
    )


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "review_sentences").select(F.col("run_id").alias("scope"), clean_id("sentence_id").alias("id"), "created_at")
    return orphan_references(parents, sentence_references(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence ids that have no row, or only a later one, in the sentences of their run."""
    return _orphans(spark, sf_dir).select("ref_table", "ref_month", F.col("scope").alias("run_id"), "ref_key", F.col("id").alias("sentence_id"), "kind")


def p7_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of orphan references per table, month and kind."""
    return orphans_by_period(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p3_found, p3_aspects, p3_list_sizes, p4_found, p4_review_keys, p4_aspect_keys, p4_category_ratings, p7_found, p7_by_month)}

_TRIMMED = r"nullif(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '')"

_REFS = rf"""
WITH refs AS (
  SELECT 'aspect_sentiment_valid' AS ref_table, strftime(created_at, '%Y-%m') AS ref_month, run_id, aspect_norm AS ref_key, {_TRIMMED.format("sentence_id")} AS sentence_id, created_at FROM aspect_sentiment_valid
  UNION ALL
  SELECT 'cluster_stats', strftime(created_at, '%Y-%m'), run_id, cluster_id, {_TRIMMED.format("id")}, created_at
  FROM (SELECT run_id, cluster_id, created_at, unnest(CAST(representative_sentence_ids AS VARCHAR[])) AS id FROM cluster_stats)
  UNION ALL
  SELECT 'cluster_reports', strftime(created_at, '%Y-%m'), run_id, cluster_id, {_TRIMMED.format("json_extract_string(e, '$.sentence_id')")}, created_at
  FROM (SELECT run_id, cluster_id, created_at, unnest(CASE json_type(items) WHEN 'ARRAY' THEN CAST(items AS JSON[]) WHEN 'OBJECT' THEN [items] END) AS e
        FROM (SELECT run_id, cluster_id, created_at, CASE WHEN json_type(evidence_items) = 'VARCHAR' THEN CAST(json_extract_string(evidence_items, '$') AS JSON) ELSE CAST(evidence_items AS JSON) END AS items FROM cluster_reports))
), parents AS (
  SELECT run_id, {_TRIMMED.format("sentence_id")} AS sentence_id, min(created_at) AS parent_at FROM review_sentences GROUP BY 1, 2
), orphans AS (
  SELECT DISTINCT ref_table, ref_month, r.run_id, ref_key, r.sentence_id, CASE WHEN p.sentence_id IS NULL THEN 'missing' ELSE 'late' END AS kind
  FROM refs r LEFT JOIN parents p ON r.run_id = p.run_id AND r.sentence_id = p.sentence_id
  WHERE r.sentence_id IS NOT NULL AND (p.sentence_id IS NULL OR p.parent_at > r.created_at)
)
"""

_ITEMS = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE [] END"


def list_rows(source: str, column: str, name: str, outer: str = "") -> str:
    """Rows of one list: its elements with their places, JSON nulls left out."""
    place = f"{outer} || '.' || CAST(i - 1 AS VARCHAR)" if outer else "CAST(i - 1 AS VARCHAR)"
    return f"""SELECT source_table, run_id, parent_key, '{name}' AS list_name, {place} AS item_path, l[i] AS item
    FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, {_ITEMS.format(column)} AS l FROM {source})) WHERE json_type(l[i]) <> 'NULL'"""


def decoded_json(column: str) -> str:
    """JSON of a text that may be encoded as a string, or hold its JSON between other words."""
    plain = f"CASE WHEN json_valid({column}) THEN {column} ELSE nullif(regexp_extract({column}, '(?s)[{{\\[].*[}}\\]]'), '') END"
    return f"CAST(CASE WHEN json_type({plain}) = 'VARCHAR' THEN json_extract_string({plain}, '$') ELSE {plain} END AS JSON)"


_P3 = f"""
WITH decoded AS (
  SELECT run_id, sentence_id || '#' || CAST(retry_count AS VARCHAR) AS parent_key, {decoded_json("llm_output")} AS p FROM aspect_sentiment_raw WHERE parse_status = 'SUCCESS' AND llm_output IS NOT NULL
), records AS (
  SELECT 'aspect_sentiment_raw' AS source_table, run_id, parent_key, coalesce(json_extract(p, '$.result'), json_extract(p, '$.data.output'), p) AS r FROM decoded
), reported AS (
  SELECT 'cluster_reports' AS source_table, run_id, cluster_id AS parent_key, {decoded_json("evidence_items")} AS e, {decoded_json("action_items")} AS a FROM cluster_reports
), aspects AS ({list_rows("records", "json_extract(r, '$.aspects')", "aspects")}),
warnings AS ({list_rows("records", "json_extract(r, '$.extraction_warnings')", "extraction_warnings")}),
spans AS ({list_rows("aspects", "json_extract(item, '$.evidence_spans')", "aspects.evidence_spans", "item_path")}),
evidence AS ({list_rows("reported", "e", "evidence_items")}),
actions AS ({list_rows("reported", "a", "action_items")}),
steps AS ({list_rows("actions", "json_extract(item, '$.validation_plan.steps')", "action_items.validation_plan.steps", "item_path")}),
items AS (SELECT DISTINCT source_table, run_id, parent_key, list_name, item_path FROM (
  SELECT * FROM aspects UNION ALL SELECT * FROM warnings UNION ALL SELECT * FROM spans UNION ALL SELECT * FROM evidence UNION ALL SELECT * FROM actions UNION ALL SELECT * FROM steps))
"""

ORACLES = {
    "p3_found": _P3 + "SELECT * FROM items",
    "p3_list_sizes": _P3 + "SELECT source_table, list_name, count(*) AS n_elements FROM items GROUP BY 1, 2",
    "p3_aspects": _P3
    + """SELECT DISTINCT run_id, parent_key, CAST(item_path AS INT) AS ordinal, json_extract_string(item, '$.aspect') AS aspect, json_extract_string(item, '$.sentiment') AS sentiment, json_extract_string(item, '$.issue') AS issue,
      json_extract_string(item, '$.evidence_text') AS evidence_text, TRY_CAST(json_extract_string(item, '$.sentiment_score') AS DOUBLE) AS sentiment_score, TRY_CAST(json_extract_string(item, '$.confidence') AS DOUBLE) AS confidence FROM aspects""",
    "p4_found": """
        SELECT 'reviews' AS source_table, parent_asin AS key_value FROM reviews WHERE parent_asin IS NOT NULL GROUP BY parent_asin HAVING count(*) >= 0.04 * (SELECT count(*) FROM reviews)
        UNION ALL
        SELECT 'aspect_sentiment_valid', aspect_norm FROM aspect_sentiment_valid WHERE aspect_norm IS NOT NULL GROUP BY aspect_norm HAVING count(*) >= 0.04 * (SELECT count(*) FROM aspect_sentiment_valid)""",
    "p4_review_keys": "SELECT parent_asin, count(*) AS n_rows, round(sum(rating) / nullif(count(rating), 0), 6) AS mean_rating FROM reviews WHERE parent_asin IS NOT NULL GROUP BY parent_asin",
    "p4_aspect_keys": "SELECT aspect_norm, count(*) AS n_rows, round(sum(sentiment_score) / nullif(count(sentiment_score), 0), 6) AS mean_sentiment_score FROM aspect_sentiment_valid WHERE aspect_norm IS NOT NULL GROUP BY aspect_norm",
    "p4_category_ratings": "SELECT main_category, count(*) AS n_rows, round(avg(rating), 6) AS mean_rating FROM reviews LEFT JOIN (SELECT DISTINCT parent_asin, main_category FROM meta) USING (parent_asin) GROUP BY main_category",
    "p7_found": _REFS + "SELECT * FROM orphans",
    "p7_by_month": _REFS + "SELECT ref_table, ref_month, kind, count(*) AS n_references, count(DISTINCT sentence_id) AS n_ids FROM orphans GROUP BY 1, 2, 3",
}
