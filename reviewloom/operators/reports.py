"""Evaluation figures, cluster samples, insights, and report and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.flatten import decode
from reviewloom.operators.selection import first_per

#: Actions by aspect (fixed values), tried in this order; the last holds for all others.
ACTIONS = (
    ("battery", "优化电池续航和充电速度", "product", "提升用户满意度，减少退货率", "A/B测试新电池方案，收集用户反馈"),
    ("screen", "改进屏幕显示质量和耐用性", "design", "提升产品竞争力", "抽检屏幕质量，对比竞品"),
    ("quality", "加强质量控制和质检流程", "quality", "降低缺陷率，提升品牌形象", "建立质量监控体系，定期抽检"),
    ("price", "优化定价策略或提升性价比", "product", "提升销量和市场份额", "市场调研，分析竞品定价"),
    ("default", "深入调研用户反馈，制定改进计划", "product", "提升用户满意度", "用户访谈，数据分析"),
)
#: Texts of the summary (fixed values).
SUMMARY = ("用户在 ", " 方面主要反馈 ", "，负面率 ", "，样本量 ", "。", "负面反馈占比较高，需要重点关注。", "整体反馈较为正面。", "various issues")
#: Action added where most opinions are negative (fixed values).
URGENT_ACTION = ("优先处理负面反馈，制定快速响应方案", "customer_service", "降低用户流失率", "跟踪用户反馈变化趋势")
#: Why an evidence stands for its cluster, what a model's insight is called without name or summary, and missing samples (fixed values).
REPRESENTATIVE, UNNAMED, NO_SUMMARY, NO_SAMPLES = "代表样本", "未命名簇", "无摘要", "无代表样本"
SAMPLES, EVIDENCE, QUOTE = 20, 5, 200
PRIORITIES = {"high": 1, "medium": 2, "low": 3}


def guarded(part: Column, whole: Column) -> Column:
    """Ratio that is 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def latest_rows(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Latest successful row per key; equal times are settled by attempt, model, prompt and payload."""
    order = [F.desc("created_at"), F.desc("retry_count"), F.col("llm_model").asc_nulls_last(), F.col("prompt_version").asc_nulls_last(), F.col("llm_output").asc_nulls_last()]
    return first_per(raw.where("parse_status = 'SUCCESS'"), keys, order)


def clusters_once(stats: DataFrame) -> DataFrame:
    """One row per cluster of a run: the first written, of several at once the largest."""
    order = [F.asc("created_at"), F.desc_nulls_last("cluster_size"), F.col("neg_ratio").asc_nulls_last(), F.col("representative_sentence_ids").asc_nulls_last()]
    return first_per(stats, ["run_id", "aspect_norm", "cluster_id"], order)


def representatives(stats: DataFrame) -> DataFrame:
    """Representative sentences of each cluster, one row each, with their place."""
    ids = F.posexplode(F.from_json("representative_sentence_ids", "array<string>")).alias("position", "sentence_id")
    return stats.select("run_id", "aspect_norm", "cluster_id", ids).where("sentence_id is not null")


def cluster_samples(stats: DataFrame, sentences: DataFrame, valid: DataFrame, most: int = SAMPLES) -> DataFrame:
    """Up to `most` samples per cluster: representative sentences with the opinions in them, in the order of the places."""
    s = first_per(sentences.select("run_id", "sentence_id", "target_sentence"), ["run_id", "sentence_id"], [F.col("target_sentence").asc_nulls_last()])
    v = valid.select("run_id", "sentence_id", F.col("aspect_norm").alias("sample_aspect"), "issue_norm").distinct()
    joined = representatives(stats).join(s, ["run_id", "sentence_id"]).join(v, ["run_id", "sentence_id"])
    order = Window.partitionBy("run_id", "aspect_norm", "cluster_id").orderBy("position", F.col("sample_aspect").asc_nulls_last(), F.col("issue_norm").asc_nulls_last())
    return joined.withColumn("sample_no", F.row_number().over(order)).where(F.col("sample_no") <= most)


def priority(size: Column, neg: Column) -> Column:
    score = size * neg
    return F.when((score > 20) | (size > 50) & (neg > 0.7), "high").when((score > 10) | (size > 20) & (neg > 0.5), "medium").otherwise("low")


def urgency(neg: Column) -> Column:
    return F.when(neg > 0.7, "high").when(neg > 0.5, "medium").otherwise("low")


def template_confidence(size: Column, neg: Column) -> Column:
    extra = F.when(size > 20, 0.1).when(size > 10, 0.05).otherwise(0.0) + F.when((neg > 0.8) | (neg < 0.2), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(0.7) + extra), 4)


def default_confidence(size: Column) -> Column:
    """Confidence of a model's insight that names none."""
    return F.when(size > 5, 0.8).when(size > 2, 0.7).otherwise(0.6)


def fallback_priority(size: Column, neg: Column) -> Column:
    """Priority where no insight could be made."""
    return F.when(size < 10, "low").when((neg > 0.5) & (size > 20), "high").otherwise("medium")


def percent(ratio: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(ratio * 100, 1)), F.lit("%"))


def action_rule(aspect: Column) -> Column:
    """First action whose key is part of the aspect or holds it: struct (action, owner_team, expected_impact, validation_plan)."""
    lower = F.lower(aspect)
    rule = lambda r: F.struct(*[F.lit(x).alias(n) for x, n in zip(r[1:], ("action", "owner_team", "expected_impact", "validation_plan"), strict=True)])
    tests = [F.when(F.contains(lower, F.lit(r[0])) | F.contains(F.lit(r[0]), lower), rule(r)) for r in ACTIONS]
    return F.coalesce(*tests, rule(ACTIONS[-1]))


def rationale(size: Column, neg: Column) -> Column:
    """Why a cluster has its priority."""
    share, n = percent(neg), size.cast("string")
    return (
        F.when(priority(size, neg) == "high", F.concat(F.lit("规模大("), n, F.lit(")且负面率高("), share, F.lit(")")))
        .when(priority(size, neg) == "medium", F.concat(F.lit("规模中等("), n, F.lit(")，负面率"), share))
        .otherwise(F.concat(F.lit("规模较小("), n, F.lit(")或负面率较低("), share, F.lit(")")))
    )


def _action(values: Column | tuple, urgent: Column) -> Column:
    names = ("action", "owner_team", "expected_impact", "validation_plan")
    held = [values[n] for n in names] if isinstance(values, Column) else [F.lit(v) for v in values]
    return F.struct(*[v.alias(n) for n, v in zip(names, held, strict=True)], urgent.alias("urgency"))


def action_items(aspect: Column, neg: Column) -> Column:
    """Actions of a cluster: the rule of its aspect, and a second one where most opinions are negative."""
    first, second = _action(action_rule(aspect), urgency(neg)), _action(URGENT_ACTION, F.lit("high"))
    return F.when(neg > 0.7, F.array(first, second)).otherwise(F.array(first))


def insights(stats: DataFrame, samples: DataFrame) -> DataFrame:
    """Name, summary, priority with its reason, confidence, evidence and actions of every cluster, from templates.

    evidence_items and action_items are arrays of structs; `action`, `owner_team` and `urgency` are those of the first action.
    """
    keys = ["run_id", "aspect_norm", "cluster_id"]
    tokens = samples.select(*keys, "sample_no", F.posexplode(F.slice(F.filter(F.split(F.lower(F.coalesce("issue_norm", F.lit(""))), r"\s+"), lambda w: w != ""), 1, 3)).alias("token_no", "token"))
    counted = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sample_no", "token_no")).alias("seen"))
    top = first_per(counted, keys, [F.desc("n"), F.col("seen.sample_no"), F.col("seen.token_no")]).select(*keys, F.col("token").alias("top_token"))
    quoted = F.struct("sample_no", "issue_norm", "sentence_id", F.substring("target_sentence", 1, QUOTE).alias("quote"))
    early = samples.where(F.col("sample_no") <= EVIDENCE).groupBy(*keys).agg(F.sort_array(F.collect_list(quoted)).alias("early"))
    terms = F.array_join(F.slice(F.filter(F.transform("early", lambda x: x["issue_norm"]), lambda t: t != ""), 1, 3), ", ")
    evidence = F.transform("early", lambda x: F.struct(x["sentence_id"].alias("sentence_id"), x["quote"].alias("quote"), F.lit(REPRESENTATIVE).alias("why_representative")))
    none = F.array().cast("array<struct<sentence_id:string,quote:string,why_representative:string>>")
    rows = stats.join(top, keys, "left").join(early, keys, "left")
    size, neg = F.coalesce("cluster_size", F.lit(0)), F.coalesce("neg_ratio", F.lit(0.0))
    name = F.concat("aspect_norm", F.coalesce(F.concat(F.lit(": "), "top_token"), F.lit(" issue cluster")))
    head, about, share, count, end, much, little, various = (F.lit(x) for x in SUMMARY)
    summary = F.concat(head, "aspect_norm", about, F.coalesce(F.nullif(terms, F.lit("")), various), share, percent(neg), count, size.cast("string"), end, F.when(neg > 0.7, much).when(neg < 0.3, little).otherwise(""))
    actions = action_items(F.col("aspect_norm"), neg)
    rows = rows.select(*keys, name.alias("cluster_name"), summary.alias("summary"), priority(size, neg).alias("priority"), rationale(size, neg).alias("priority_rationale"), template_confidence(size, neg).alias("confidence"), F.coalesce(evidence, none).alias("evidence_items"), actions.alias("action_items"))
    first = F.col("action_items")[0]
    return rows.select("*", first["action"].alias("action"), first["owner_team"].alias("owner_team"), first["urgency"].alias("urgency"), F.size("action_items").alias("n_actions"))


def fallback_insights(stats: DataFrame, samples: DataFrame) -> DataFrame:
    """The plain insight of clusters whose model call failed: name, summary, priority, confidence, evidence and one action."""
    keys = ["run_id", "aspect_norm", "cluster_id"]
    size, neg = F.coalesce("cluster_size", F.lit(0)), F.coalesce("neg_ratio", F.lit(0.0))
    own = insights(stats, samples).select(*keys, "evidence_items")
    rows = stats.join(own, keys)
    ranked = fallback_priority(size, neg)
    name = F.concat("aspect_norm", F.lit(" issue cluster "), "cluster_id")
    summary = F.concat(F.lit("Cluster contains "), size.cast("string"), F.lit(" issues related to "), "aspect_norm", F.lit(". Negative sentiment ratio: "), F.format_string("%.2f", F.round(neg * 100, 2)), F.lit("%."))
    action = F.struct(F.concat(F.lit("Investigate "), "aspect_norm", F.lit(" issues")).alias("action"), F.lit("product").alias("owner_team"), F.lit(None).cast("string").alias("expected_impact"), F.lit(None).cast("string").alias("validation_plan"), ranked.alias("urgency"))
    return rows.select(*keys, name.alias("cluster_name"), summary.alias("summary"), ranked.alias("priority"), F.lit(0.5).alias("confidence"), "evidence_items", F.array(action).alias("action_items"))


def sample_blocks(samples: DataFrame, keys: list[str], most: int = SAMPLES) -> DataFrame:
    """(keys, samples): the samples of each cluster as the text blocks of a prompt, in order."""
    part = lambda label, c: F.concat(F.lit(f"  - {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))
    block = F.concat(F.lit("样本"), F.col("sample_no").cast("string"), F.lit(":\n"), part("sentence_id", "sentence_id"), part("句子", "target_sentence"), part("问题", "issue_norm"), part("情感", "sentiment"), part("有用票数", "helpful_vote"))
    listed = samples.where(F.col("sample_no") <= most).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("sample_no", block.alias("block")))).alias("b"))
    return listed.select(*keys, F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("samples"))


def repaired_items(listed: DataFrame, keys: list[str], names: tuple[str, ...], main: str, others: tuple[str, ...]) -> DataFrame:
    """Elements of a model's list as objects: bare texts become the main field, which older names may hold; empty ones drop.

    listed: keys, ordinal, value (the element as text), and the fields `names`, `main` and `others` as text columns.
    """
    bare = F.when(~F.col("value").rlike(r"^\s*[\[{]"), F.col("value"))
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (main, *others)], F.nullif(bare, F.lit("")))
    return listed.select(*keys, "ordinal", text.alias(main), *[F.col(n) for n in names]).where(F.col(main).isNotNull())


def repair_insight(answer: str | None) -> dict:
    """A model's insight in its declared form: bare texts as objects, older field names, defaults for what is missing.

    An answer without an object is a ValueError.
    """
    value = decode(answer)
    if not isinstance(value, dict):
        raise ValueError("no object")

    def items(name: str, main: str, others: tuple[str, ...], optional: tuple[str, ...], fixed: dict) -> list[dict]:
        out = []
        for item in value.get(name) if isinstance(value.get(name), list) else []:
            if isinstance(item, str):
                item = {main: item}
            if isinstance(item, dict):
                text = next((str(item[c]) for c in (main, *others) if item.get(c)), "")
                if text:
                    out.append({**{k: item.get(k, v) for k, v in fixed.items()}, main: text, **{k: item.get(k) for k in optional}})
        return out

    out = {"cluster_name": value.get("cluster_name") or UNNAMED, "summary": value.get("summary") or NO_SUMMARY}
    out["priority"] = value.get("priority") if value.get("priority") in PRIORITIES else "medium"
    out["evidence_items"] = items("evidence_items", "quote", ("text", "evidence"), ("why_representative",), {"sentence_id": ""})
    out["action_items"] = items("action_items", "action", ("text", "suggestion"), ("owner_team", "expected_impact", "validation_plan", "urgency"), {})
    confidence = value.get("confidence")
    out["confidence"] = float(confidence) if isinstance(confidence, (int, float)) and not isinstance(confidence, bool) else None
    return out


def busy_sentences(valid: DataFrame, more_than: int = 10) -> DataFrame:
    """(run_id, sentence_id, n) of sentences with more than so many VALID opinions, repeated rows counted."""
    return valid.where("validity_label = 'VALID'").groupBy("run_id", "sentence_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def cluster_key_text(aspect: Column, issue: Column) -> Column:
    """The text that stands for an opinion when it is encoded."""
    return F.concat(F.lit("Aspect: "), F.coalesce(aspect, F.lit("")), F.lit("\nIssue: "), F.coalesce(issue, F.lit("")))


def coverage_metrics(counts: DataFrame) -> DataFrame:
    """Metrics in tall form from one row of counts per run; the share of valid aspects is capped at 1."""
    rates = {
        "candidate_coverage": guarded(F.col("n_candidates"), F.col("n_sentences")),
        "extraction_success_rate": guarded(F.col("n_success"), F.col("n_candidates")),
        "valid_rate": F.least(F.lit(1.0), guarded(F.col("n_valid"), F.col("n_aspects"))),
        "valid_sentence_rate": guarded(F.col("n_valid_sentences"), F.col("n_success")),
    }
    wide = counts.select("run_id", *[F.round(r, 6).alias(n) for n, r in rates.items()])
    return wide.unpivot("run_id", list(rates), "metric_name", "metric_value").withColumn("metric_scope", F.lit("overall"))


def report_rows(reports: DataFrame, stats: DataFrame, most: int = 20) -> DataFrame:
    """First rows of each run's report, by priority, size and cluster id as text, numbered."""
    r = first_per(reports, ["run_id", "aspect_norm", "cluster_id"], [F.asc("created_at"), F.col("priority").asc_nulls_last(), F.col("cluster_name").asc_nulls_last(), F.col("confidence").asc_nulls_last()])
    s = stats.select("run_id", "aspect_norm", "cluster_id", "cluster_size", "neg_ratio")
    joined = r.join(s, ["run_id", "aspect_norm", "cluster_id"], "left")
    rank = F.coalesce(*[F.when(F.col("priority") == p, n) for p, n in PRIORITIES.items()], F.lit(4))
    order = Window.partitionBy("run_id").orderBy(rank, F.coalesce("cluster_size", F.lit(0)).desc(), "cluster_id", "aspect_norm")
    return joined.withColumn("report_no", F.row_number().over(order)).where(F.col("report_no") <= most)


def flat(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\n\r", "  ")


def thousands(value: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(value, 0)


def shown_metric(name: Column, value: Column) -> Column:
    """Shares in per cent, other metrics with four places."""
    return F.when(name.rlike("coverage|rate"), F.concat(F.format_string("%.2f", F.round(value * 100, 2)), F.lit("%"))).otherwise(F.format_string("%.4f", value))


def number(value: Column, places: int = 4) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.round(value, places))).otherwise("")


#: Columns of the export, in order (fixed values).
EXPORT_COLUMNS = (
    "aspect_norm cluster_id cluster_name is_noise issue_norm sentiment cluster_key_text priority cluster_size neg_ratio intra_cluster_distance inter_cluster_distance separation_ratio cohesion "
    "cluster_confidence sentiment_consistency insight_confidence representative_sentence_ids summary sentence_id review_pk parent_asin timestamp rating verified_purchase helpful_vote sentence_index "
    "target_sentence prev_sentence next_sentence context_text"
).split()


def export_order() -> list[Column]:
    """Order of the export within a run: noise comes last within an aspect, ids sort as padded text, later sentences first."""
    noise = F.col("cluster_id") == "noise"
    padded = F.when(noise, "zzz_noise").otherwise(F.lpad("cluster_id", 10, "0"))
    return [F.col("aspect_norm"), noise.cast("int"), padded, F.col("unix_ts").desc_nulls_last(), F.col("sentence_id"), F.col("issue_norm"), F.col("sentiment")]


def export_rows(clusters: DataFrame, stats: DataFrame, reports: DataFrame, sentences: DataFrame) -> DataFrame:
    """Export rows of clustered opinions with statistics, insight and sentence, all as text, and unix_ts for the order.

    clusters: run_id, aspect_norm, cluster_id, sentence_id, issue_norm, sentiment, cluster_key_text, is_noise. What is
    missing is empty. A cluster counts with its first report, a sentence with its first row in the run.
    """
    keys = ["run_id", "aspect_norm", "cluster_id"]
    own = ["review_pk", "parent_asin", "unix_ts", "rating", "verified_purchase", "helpful_vote", "sentence_index", "target_sentence", "prev_sentence", "next_sentence", "context_text"]
    r = first_per(reports, keys, [F.asc("created_at"), F.col("cluster_name").asc_nulls_last()]).select(*keys, "cluster_name", "summary", "priority", F.col("confidence").alias("insight_confidence"))
    s = first_per(sentences, ["run_id", "sentence_id"], [F.asc("created_at"), F.col("target_sentence").asc_nulls_last(), F.col("context_text").asc_nulls_last()]).select("run_id", "sentence_id", *own)
    measures = ["neg_ratio", "intra_cluster_distance", "inter_cluster_distance", "separation_ratio", "cohesion", "cluster_confidence", "sentiment_consistency"]
    joined = clusters.join(stats.select(*keys, "cluster_size", *measures, "representative_sentence_ids"), keys, "left").join(r, keys, "left").join(s, ["run_id", "sentence_id"], "left")
    yes = lambda c: F.when(c, "是").when(c.isNotNull(), "否").otherwise("")
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EXPORT_COLUMNS if c != "timestamp"} | {"timestamp": F.coalesce(F.col("unix_ts").cast("string"), F.lit(""))}
    shown |= {c: number(F.col(c)) for c in (*measures, "insight_confidence")} | {"rating": number(F.col("rating"), 1)}
    shown |= {c: flat(F.col(c)) for c in ("target_sentence", "prev_sentence", "next_sentence", "context_text")}
    shown |= {"verified_purchase": yes(F.col("verified_purchase")), "is_noise": F.when(F.col("is_noise"), "是").otherwise("否")}
    return joined.select("run_id", "unix_ts", *[shown[c].alias(c) for c in EXPORT_COLUMNS])


def failure_ratios(counts: DataFrame) -> DataFrame:
    """candidate_rate, valid_per_candidate and noise_rate of each run, from n_sentences, n_candidates, n_valid and n_noise."""
    rates = {"candidate_rate": ("n_candidates", "n_sentences"), "valid_per_candidate": ("n_valid", "n_candidates"), "noise_rate": ("n_noise", "n_valid")}
    return counts.select("run_id", *[F.round(guarded(F.col(a), F.col(b)), 6).alias(n) for n, (a, b) in rates.items()])


def export_summary(clusters: DataFrame) -> DataFrame:
    """Per run: records, clusters without noise, noise records, and the aspects in order."""
    aspects = F.array_join(F.sort_array(F.collect_set(F.nullif(F.col("aspect_norm"), F.lit("")))), ",")
    return clusters.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(F.when(F.col("cluster_id") != "noise", F.col("cluster_id"))).alias("n_clusters"), F.count_if("is_noise").alias("n_noise"), aspects.alias("aspects"))
