"""Columns of the tables of a run (fixed values: names, order and types), and bringing frames into that form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERSION = "run_id string not null, pipeline_version string not null, data_slice_id string not null, created_at timestamp not null"
_VALID = (
    f"{_VERSION}, sentence_id string not null, review_pk string not null, parent_asin string not null, unix_ts bigint not null, rating double not null, aspect_raw string not null, aspect_norm string not null, "
    "sentiment string not null, sentiment_score double, issue_raw string not null, issue_norm string not null, evidence_text string not null, validity_label string not null, quality_flags string"
)
_ISSUES = f"{_VERSION}, sentence_id string not null, issue_type string not null, details string, needs_recheck boolean"
_CLUSTERS = (
    f"{_VERSION}, embedding_model string not null, clustering_config_id string not null, aspect_norm string not null, cluster_id string not null, sentence_id string not null, cluster_key_text string not null, "
    "issue_norm string not null, sentiment string not null, is_noise boolean, cluster_embedding array<float>"
)
_STATS = (
    f"{_VERSION}, aspect_norm string not null, cluster_id string not null, cluster_size int not null, neg_ratio double not null, intra_cluster_distance double, inter_cluster_distance double, separation_ratio double, "
    "cohesion double, cluster_confidence double, sentiment_consistency double, recent_trend string, top_terms string, representative_sentence_ids string not null"
)
_REPORT = "aspect_norm string not null, cluster_id string not null, cluster_name string not null, summary string not null, priority string not null"

#: DDL of each table. Times are long, as milliseconds do not fit an int, and called unix_ts; JSON is text; vectors are arrays of any length.
TABLES = {
    "selected_reviews": f"{_VERSION}, source_snapshot_at timestamp, review_pk string not null, parent_asin string not null, asin string, user_id string, unix_ts bigint not null, rating double not null, verified_purchase boolean, helpful_vote int, review_title string, review_text string not null, main_category string, product_title string",
    "meta_context": f"{_VERSION}, parent_asin string not null, product_title string not null, main_category string, features_short string, description_short string, details_short string, context_version string not null",
    "normalized_reviews": f"{_VERSION}, review_pk string not null, parent_asin string not null, unix_ts bigint not null, rating double not null, clean_text string not null, cleaning_flags string",
    "review_sentences": f"{_VERSION}, sentence_id string not null, review_pk string not null, parent_asin string not null, unix_ts bigint not null, rating double not null, verified_purchase boolean, helpful_vote int, sentence_index int not null, target_sentence string not null, prev_sentence string, next_sentence string, context_text string not null",
    "opinion_candidates": f"{_VERSION}, sentence_id string not null, is_candidate boolean not null, filter_reason string, priority_weight double",
    "aspect_sentiment_raw": f"{_VERSION}, llm_model string not null, prompt_version string not null, sentence_id string not null, parse_status string not null, retry_count int not null, error_type string, llm_output string",
    "aspect_sentiment_valid": _VALID,
    "extraction_issues": _ISSUES,
    "issue_clusters": _CLUSTERS,
    "cluster_stats": _STATS,
    "cluster_reports": f"{_VERSION}, llm_model string not null, prompt_version string not null, {_REPORT}, evidence_items string not null, action_items string not null, risks_and_assumptions string, confidence double",
    "evaluation_metrics": f"{_VERSION}, metric_name string not null, metric_value double not null, metric_scope string, notes string",
    "run_log": "run_id string not null, step_name string not null, status string not null, input_rows int, output_rows int, error_rows int, started_at timestamp not null, finished_at timestamp, message string",
    "aspect_sentiment_raw_traditional": f"{_VERSION}, sentence_id string not null, extract_method string not null, aspect_raw string not null, issue_raw string not null, sentiment string not null, sentiment_score double, evidence_text string not null, debug_features string",
    "aspect_sentiment_valid_traditional": _VALID,
    "extraction_issues_traditional": _ISSUES,
    "issue_clusters_traditional": _CLUSTERS,
    "cluster_stats_traditional": _STATS,
    "cluster_reports_traditional": f"{_VERSION}, method_version string not null, {_REPORT}, priority_rationale string, evidence_items string not null, action_items string not null, confidence double",
}


def schema_of(table: str) -> T.StructType:
    """Declared columns of a table; an unknown table is an error."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The frame in the declared columns, order and types; what it lacks is NULL, what is not declared is an error."""
    schema = schema_of(table)
    unknown = sorted(set(df.columns) - set(schema.names))
    if unknown:
        raise ValueError(f"columns not declared for {table}: {unknown}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def require_declared(df: DataFrame, table: str) -> DataFrame:
    """The same frame, whose action fails on a NULL in a column that is declared without."""
    needed = [f.name for f in schema_of(table) if not f.nullable and f.name in df.columns]
    checks = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{table}.{c} is NULL"))).otherwise(F.col(c)).alias(c) if c in needed else F.col(c) for c in df.columns]
    return df.select(*checks)


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the tables that the catalogue lacks, partitioned by run."""
    made = []
    for name, ddl in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet PARTITIONED BY (run_id)")
            made.append(name)
    return made
