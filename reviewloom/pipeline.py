"""A whole run, from reviews to report: each step reads the stored rows of its run and writes its own tables.

Two paths: `lexicon` extracts opinions by word lists, `model` asks a completion model; what follows is the same. Every step is
one chain of DataFrame operators, so that nothing but counts, metrics and the page of the report reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import lexicons as lx
from reviewloom.functions.text import slice_id
from reviewloom.operators import extraction, kernels, neighbor_graph, normalize, opinion, payloads, providers, reports, selection, vectors
from reviewloom.operators.ordering import numbered
from reviewloom.operators.selection import Slice, first_per
from reviewloom.sources import report, sinks
from reviewloom.sources.tables import materialize, scratch

KEYS = ["run_id", "aspect_norm", "cluster_id"]
#: Clusters that get an insight, and that the report shows.
INSIGHTS, SHOWN = 50, 20
#: Prompt of extraction where none is configured.
PROMPT = "Name the aspects of the product that the sentence judges.\nSentence: {target_sentence}\nContext: {context_text}\nProduct: {product_title}\nFeatures: {features_short}"


@dataclass(frozen=True)
class RunConfig:
    """What a run does: its slice, path, models, and the parameters of clustering."""

    wanted: Slice = Slice()
    method: str = "lexicon"
    pipeline_version: str = "1.0"
    prompt: str = PROMPT
    prompt_version: str = "v1.0"
    context_version: str = "v1.0"
    extraction_model: providers.ModelConfig = field(default_factory=providers.ModelConfig)
    embed: Callable[[], providers.Embedder] = providers.HashedNgrams
    fuzzy: bool = True
    synonyms: dict[str, str] = field(default_factory=lambda: dict(lx.ASPECT_SYNONYMS))
    aspect_similarity: float = 0.85
    linkage_threshold: float = 0.5
    min_samples: int = 3
    adsorb_from: float = 0.7
    merge_from: float = 0.75
    smallest_cluster: int = 2
    two_stages: bool = True
    reranker: Callable[[], providers.Reranker] | None = None
    rerank_from: float = 0.6
    rerank_candidates: int = 50

    @property
    def slice_name(self) -> str:
        w = self.wanted
        time = None if w.first_ts is None and w.last_ts is None else f"{w.first_ts}-{w.last_ts}"
        filters = {k: v for k, v in (("verified", w.verified), ("min_helpful", w.min_helpful), ("limit", w.limit)) if v is not None}
        return slice_id(w.category, w.parent_asin, time, filters or None)


def table_name(config: RunConfig, table: str) -> str:
    return f"{table}_traditional" if config.method == "lexicon" and table in sinks.TRADITIONAL else table


class Run:
    """The steps of one run over a store."""

    def __init__(self, store: sinks.RunStore, run: str, reviews: DataFrame, meta: DataFrame, config: RunConfig, folder: str | None = None) -> None:
        if config.method not in ("lexicon", "model"):
            raise ValueError(f"unknown method {config.method}")
        self.store, self.run, self.reviews, self.meta, self.config, self.folder = store, run, reviews, meta, config, folder

    def read(self, table: str) -> DataFrame:
        return self.store.read(table_name(self.config, table), self.run)

    def write(self, df: DataFrame, table: str) -> int:
        name = table_name(self.config, table)
        self.store.write(df, name, self.run, pipeline_version=self.config.pipeline_version, data_slice_id=self.config.slice_name)
        return self.store.read(name, self.run).count()

    def select(self) -> int:
        rows = self.write(selection.select_reviews(self.reviews, self.meta, self.config.wanted), "selected_reviews")
        selection.require_rows(self.read("selected_reviews"))
        return rows

    def meta_context(self) -> int:
        context = selection.meta_context(self.read("selected_reviews"), self.meta)
        return self.write(context.withColumn("context_version", F.lit(self.config.context_version)), "meta_context")

    def preprocess(self) -> int:
        once = first_per(self.read("selected_reviews"), ["review_pk"], [F.col("product_title").asc_nulls_last()])
        return self.write(selection.normalize_reviews(once), "normalized_reviews")

    def sentences(self) -> int:
        return self.write(selection.build_sentences(self.read("normalized_reviews")), "review_sentences")

    def opinion(self) -> int:
        scored = opinion.score_sentences(self.read("review_sentences"))
        return self.write(scored.select("sentence_id", "is_candidate", "filter_reason", "priority_weight"), "opinion_candidates")

    def _candidates(self) -> DataFrame:
        """Candidate sentences with their product."""
        kept = self.read("opinion_candidates").where("is_candidate").select("sentence_id")
        own = self.read("review_sentences").select("sentence_id", "parent_asin", "target_sentence", "context_text")
        context = self.read("meta_context").select("parent_asin", "product_title", "features_short")
        return own.join(kept, "sentence_id").join(context, "parent_asin", "left")

    def extraction(self) -> int:
        rows, c = self._candidates(), self.config
        if c.method == "lexicon":
            found = extraction.extract(rows).withColumn("debug_features", extraction.debug_features())
            return self.write(found.select("sentence_id", F.lit("LEXICON_RULE").alias("extract_method"), "aspect_raw", "issue_raw", "sentiment", "sentiment_score", "evidence_text", "debug_features"), "aspect_sentiment_raw")
        prompts = rows.select("sentence_id", providers.fill_template(c.prompt, rows.columns).alias("prompt"))
        answers = providers.complete_prompts(prompts, "sentence_id", "prompt", providers.build_completer(c.extraction_model))
        return self.write(answers.withColumns({"llm_model": F.lit(c.extraction_model.model or c.extraction_model.provider), "prompt_version": F.lit(c.prompt_version)}), "aspect_sentiment_raw")

    def judge(self) -> int:
        own = self.read("review_sentences").select("run_id", "sentence_id", "review_pk", "parent_asin", "unix_ts", "rating", "target_sentence")
        raw = self.read("aspect_sentiment_raw")
        if self.config.method == "lexicon":
            rows = raw.select("run_id", "sentence_id", "aspect_raw", "issue_raw", "sentiment", "sentiment_score", "evidence_text").join(own, ["run_id", "sentence_id"])
            found = normalize.evidence_found(F.col("evidence_text"), F.col("target_sentence"))
            names = normalize.normalize_aspects(rows, self.config.synonyms, self.config.fuzzy).select("aspect_raw", "aspect_norm")
            judged = rows.where(found).join(names, "aspect_raw").withColumn("issue_norm", normalize.strip(F.lower("issue_raw")))
            judged = judged.where(normalize.validity(F.col("aspect_norm"), F.col("issue_norm")) == "VALID")
            valid = first_per(judged, ["sentence_id", "aspect_norm", "issue_norm"], [F.col("aspect_raw")])
            issues = rows.where(~found).select("sentence_id", F.lit("EVIDENCE_NOT_FOUND").alias("issue_type"))
        else:
            latest = reports.latest_rows(raw, ["run_id", "sentence_id"])
            valid, issues = payloads.judge_payloads(latest.select("run_id", "sentence_id", "llm_output"), own, self.config.fuzzy, self.config.synonyms)
            valid = valid.withColumn("issue_raw", F.col("issue_norm")).join(own.drop("target_sentence"), ["run_id", "sentence_id"])
        self.write(issues.select("sentence_id", "issue_type"), "extraction_issues")
        flags = normalize.rating_conflict(F.col("rating"), F.col("sentiment")).alias("quality_flags")
        columns = ["sentence_id", "review_pk", "parent_asin", "unix_ts", "rating", "aspect_raw", "aspect_norm", "sentiment", "sentiment_score", "issue_raw", "issue_norm", "evidence_text"]
        return self.write(valid.select(*columns, F.lit("VALID").alias("validity_label"), flags), "aspect_sentiment_valid")

    def clustering(self) -> int:
        with scratch():
            return self._clustering()

    def _clustering(self) -> int:
        c, valid = self.config, self.read("aspect_sentiment_valid")
        text = reports.cluster_key_text(F.col("aspect_norm"), F.col("issue_norm"))
        rows = valid.select(F.concat_ws("|", "sentence_id", "aspect_norm", "issue_norm").alias("k"), "sentence_id", "aspect_norm", "issue_norm", "sentiment", text.alias("cluster_key_text"))
        coded = providers.encode_texts(rows, "cluster_key_text", c.embed)
        named = rows.groupBy(F.col("aspect_norm").alias("text")).agg(F.count(F.lit(1)).alias("n"))
        merged = kernels.merge_names(named.join(providers.encode_texts(named, "text", c.embed), "text"), "text", "vector", "n", c.aspect_similarity)
        rows = rows.join(coded, F.col("cluster_key_text") == F.col("text")).drop("text").join(merged.withColumnRenamed("name", "aspect_norm"), "aspect_norm")
        rows = materialize(rows)
        if not c.two_stages or not kernels.worth_two_stages(rows, "canonical"):
            rows = rows.withColumn("canonical", F.lit("all"))
        local = kernels.cluster_buckets(rows, "canonical", "k", "vector", threshold=c.linkage_threshold, min_samples=c.min_samples)
        label = neighbor_graph.offset_labels(local, "bucket", "label").select("k", F.col("global_label").alias("cluster"))
        placed = materialize(rows.join(label, "k"))
        if c.reranker is not None:
            edges = neighbor_graph.reranked_edges(placed, "k", "vector", "cluster_key_text", "canonical", c.reranker, c.rerank_from, candidates=c.rerank_candidates)
            joined = neighbor_graph.reconcile_labels(placed.select("k", "cluster"), edges, "k", "cluster")
            placed = materialize(placed.drop("cluster").join(joined.withColumnRenamed("new_label", "cluster"), "k"))
        placed = materialize(placed.join(vectors.adsorb_noise(placed, "cluster", "k", "vector", c.adsorb_from), "k").drop("cluster").withColumnRenamed("new_cluster", "cluster"))
        placed = materialize(placed.join(vectors.merge_small(placed, "cluster", "k", "vector", c.smallest_cluster, c.merge_from), "k").drop("cluster").withColumnRenamed("new_cluster", "cluster"))
        dense = vectors.dense_labels(placed, "k", "cluster").withColumnRenamed("dense_label", "cluster")
        placed = materialize(placed.drop("cluster").join(dense, "k"))
        parameters = {"aspect_similarity": c.aspect_similarity, "linkage_threshold": c.linkage_threshold, "min_samples": c.min_samples, "adsorb_from": c.adsorb_from, "merge_from": c.merge_from, "smallest_cluster": c.smallest_cluster}
        stamp = {"embedding_model": F.lit(getattr(c.embed, "__name__", "custom")), "clustering_config_id": F.lit(sinks.config_id(parameters)), "cluster_id": vectors.cluster_ids(F.col("cluster")), "is_noise": F.col("cluster") == -1}
        members = placed.withColumns(stamp).select("embedding_model", "clustering_config_id", "aspect_norm", "cluster_id", "sentence_id", "cluster_key_text", "issue_norm", "sentiment", "is_noise", F.col("vector").cast("array<float>").alias("cluster_embedding"))
        self.write(members, "issue_clusters")
        inside = placed.where("cluster <> -1")
        stats = vectors.cluster_statistics(inside, "cluster", "vector", "sentiment").drop("intra_cluster_std")
        centre = vectors.medoids(inside, "cluster", "k", "vector").join(inside.select(F.col("k").alias("medoid"), "sentence_id"), "medoid").select("cluster", F.col("sentence_id").alias("medoid"))
        heads = vectors.representatives(inside, "cluster", "sentence_id", "k", centre)
        main = vectors.majority(inside, "cluster", "aspect_norm", "k")
        table = stats.join(heads, "cluster").join(main, "cluster")
        return self.write(table.select("*", vectors.cluster_ids(F.col("cluster")).alias("cluster_id"), F.to_json("ids").alias("representative_sentence_ids")).drop("cluster", "ids"), "cluster_stats")

    def insight(self) -> int:
        stats = self.read("cluster_stats").orderBy(F.desc("cluster_size"), "aspect_norm", "cluster_id").limit(INSIGHTS)
        samples = reports.cluster_samples(stats, self.read("review_sentences"), self.read("aspect_sentiment_valid"))
        made = reports.insights(stats, samples)
        columns = ["aspect_norm", "cluster_id", "cluster_name", "summary", "priority", F.to_json("evidence_items").alias("evidence_items"), F.to_json("action_items").alias("action_items"), "confidence"]
        own = ["priority_rationale", F.lit("v1.0").alias("method_version")] if self.config.method == "lexicon" else [F.lit("template").alias("llm_model"), F.lit("v1.0").alias("prompt_version")]
        return self.write(made.select(*columns, *own), "cluster_reports")

    def _counts(self) -> DataFrame:
        """One row with all counts of the run."""
        valid, raw, clusters = self.read("aspect_sentiment_valid"), self.read("aspect_sentiment_raw"), self.read("issue_clusters")
        done = raw if self.config.method == "lexicon" else raw.where("parse_status = 'SUCCESS'")
        listed = F.lit(1) if self.config.method == "lexicon" else F.coalesce(F.json_array_length(F.get_json_object("llm_output", "$.aspects")), F.lit(0))
        parts = [
            self.read("selected_reviews").agg(F.count_distinct("review_pk").alias("n_reviews")),
            self.read("opinion_candidates").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("is_candidate").alias("n_candidates")),
            done.agg(F.count_distinct("sentence_id").alias("n_success"), F.coalesce(F.sum(listed), F.lit(0)).alias("n_aspects")),
            valid.agg(F.count(F.lit(1)).alias("n_valid"), F.count_distinct("sentence_id").alias("n_valid_sentences")),
            clusters.agg(F.count_distinct(F.when(~F.col("is_noise"), F.col("cluster_id"))).alias("n_clusters"), F.count_if("is_noise").alias("n_noise")),
        ]
        row = {k: v for p in parts for k, v in p.first().asDict().items()}
        return self.store.spark.createDataFrame([(self.run, *row.values())], "run_id string, " + ", ".join(f"{k} long" for k in row))

    def evaluation(self) -> int:
        return self.write(reports.coverage_metrics(self._counts()).drop("run_id"), "evaluation_metrics")

    def report(self) -> int:
        stats, made = self.read("cluster_stats"), self.read("cluster_reports")
        page = reports.report_rows(made, stats, SHOWN).drop("cluster_size", "neg_ratio").join(stats.drop("run_id", "pipeline_version", "data_slice_id", "created_at"), ["aspect_norm", "cluster_id"], "left")
        rows = [r.asDict() for r in page.orderBy("report_no").collect()]  # at most SHOWN
        metrics = self.read("evaluation_metrics").orderBy("metric_name").select("metric_name", "metric_scope", "notes", reports.shown_metric(F.col("metric_name"), F.col("metric_value")).alias("shown"))
        means = stats.agg(*[F.avg(c).alias(f"mean_{c}") for c in ("cluster_confidence", "separation_ratio", "cohesion", "sentiment_consistency")]).first().asDict()
        about = {"run_id": self.run, "pipeline_version": self.config.pipeline_version, "data_slice_id": self.config.slice_name}
        text = report.markdown_report(about, self._counts().first().asDict(), [m.asDict() for m in metrics.collect()], means, rows)
        if self.folder:
            Path(self.folder).mkdir(parents=True, exist_ok=True)
            (Path(self.folder) / "report.md").write_text(text, encoding="utf-8")
            self.export()
        return len(rows)

    def export(self) -> int:
        """Write the CSV of all clustered opinions, in order, and its summary."""
        clusters = self.read("issue_clusters")
        rows = reports.export_rows(clusters, self.read("cluster_stats"), self.read("cluster_reports"), self.read("review_sentences"))
        ordered = numbered(rows, ["run_id"], reports.export_order(), "row_no")
        n = sinks.write_csv(ordered.select("row_no", *reports.EXPORT_COLUMNS), str(Path(self.folder) / "clusters_and_reviews.csv"), ["row_no"], reports.EXPORT_COLUMNS)
        summary = reports.export_summary(clusters).first()
        sinks.write_json({**(summary.asDict() if summary else {"run_id": self.run, "n_records": 0}), "aspects": sorted(filter(None, (summary["aspects"] if summary else "").split(",")))}, str(Path(self.folder) / "clusters_export_summary.json"))
        return n


STEPS = {"select": "select", "meta": "meta_context", "preprocess": "preprocess", "sentences": "sentences", "opinion": "opinion", "extraction": "extraction", "judge": "judge", "clustering": "clustering", "insight": "insight", "evaluation": "evaluation", "report": "report"}


def run_pipeline(spark: SparkSession, store_folder: str, run: str, reviews: DataFrame, meta: DataFrame, config: RunConfig = RunConfig(), folder: str | None = None, first: str | None = None, last: str | None = None) -> list[str]:
    """Run the steps of a run in order, from `first` on and up to `last`, logging each; the names of those done.

    Resuming cleans the tables of the steps that run again. With a folder, the report, the export, the configuration and a
    log file are written there.
    """
    store = sinks.RunStore(spark, store_folder)
    own = Run(store, run, reviews, meta, config, folder)
    if folder:
        sinks.snapshot_config(folder, {"method": config.method, "wanted": vars(config.wanted)}, run, config.pipeline_version, config.slice_name)
        sinks.log_to_file(folder).info("run %s begins", run)
    if first is not None:
        tables = {s: tuple(table_name(config, t) for t in names) for s, names in sinks.STEP_TABLES.items()}
        store.clean_from(first, run, tables)
    order = sinks.order_of_steps(sinks.STEP_NEEDS)
    if last is not None:
        wanted = {last}
        for name in reversed(order):
            wanted |= set(sinks.STEP_NEEDS[name]) if name in wanted else set()
        needs = {s: n for s, n in sinks.STEP_NEEDS.items() if s in wanted}
    else:
        needs = sinks.STEP_NEEDS
    steps = {name: partial(lambda method, _store, _run: method(), getattr(own, method)) for name, method in STEPS.items()}
    return store.run_steps(run, steps, needs, first)
