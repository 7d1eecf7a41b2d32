"""The report of a run as Markdown, from its counts, metrics and first clusters; the texts are fixed values."""

from __future__ import annotations

import json

#: Name and meaning of each metric.
METRICS = {
    "candidate_coverage": ("候选观点句覆盖率", "候选观点句数 / 总句子数，表示被识别为观点候选的句子比例"),
    "extraction_success_rate": ("抽取成功率", "成功抽取的句子数 / 候选观点句数，表示LLM成功解析的句子比例"),
    "valid_rate": ("有效aspect率", "VALID aspect记录数 / 成功抽取的总aspect数，表示通过校验的aspect比例"),
    "valid_sentence_rate": ("有效句子率", "有至少一个VALID aspect的句子数 / 成功抽取的句子数，表示至少有一个有效aspect的句子比例"),
    "silhouette_score": ("轮廓系数", "聚类质量指标，范围[-1, 1]，越大越好"),
}
COUNTS = {"n_reviews": "总评论数", "n_sentences": "总句子数", "n_candidates": "候选观点句数", "n_valid": "有效抽取记录数", "n_clusters": "簇总数", "n_noise": "噪声点数量"}
#: Label, number format and remark of each quality of a cluster.
QUALITIES = {
    "cluster_size": ("簇大小", "{:,} 条记录"),
    "neg_ratio": ("负面率", "{:.2%}"),
    "confidence": ("LLM置信度", "{:.2f}"),
    "cluster_confidence": ("聚类置信度", "{:.2f} (基于簇内一致性和分离度)"),
    "intra_cluster_distance": ("簇内平均距离", "{:.4f}"),
    "inter_cluster_distance": ("簇间最小距离", "{:.4f}"),
    "separation_ratio": ("分离度比率", "{:.4f} (簇间距离/簇内距离，越大越好)"),
    "cohesion": ("紧密度", "{:.4f} (簇内距离的倒数，越大越好)"),
    "sentiment_consistency": ("情感一致性", "{:.2%} (簇内情感分布的均匀程度)"),
}
MEANS = {"mean_cluster_confidence": ("平均聚类置信度", "{:.4f}"), "mean_separation_ratio": ("平均分离度比率", "{:.4f}"), "mean_cohesion": ("平均紧密度", "{:.4f}"), "mean_sentiment_consistency": ("平均情感一致性", "{:.2%}")}
ADVICE = ("优化观点候选过滤规则，提高候选句质量", "改进LLM抽取提示词，减少解析失败率", "优化聚类参数，减少噪声点比例", "增强方面归一化，提高簇内一致性")
ELSEWHERE = "- 详见数据库记录"


def _table(head: list[str], rows: list[list]) -> list[str]:
    return [f"| {' | '.join(map(str, r))} |" for r in (head, ["---"] * len(head), *rows)]


def _items(text: str | list | None) -> list:
    """The elements of a JSON list; nothing else is one."""
    try:
        value = json.loads(text) if isinstance(text, str) else text
    except ValueError:
        return []
    return value if isinstance(value, list) else []


def _listed(items: list, main: str, more: dict[str, str], most: int | None = None) -> list[str]:
    lines = []
    for item in items[:most]:
        item = {main: item} if isinstance(item, str) else item
        if isinstance(item, dict) and item.get(main):
            lines.append(f"- {item[main]}")
            lines += [f"  - {form.format(item[name])}" for name, form in more.items() if item.get(name)]
    return lines or [ELSEWHERE]


def _cluster(row: dict) -> list[str]:
    lines = [f"#### {row['report_no']}. {row.get('cluster_name') or '未命名簇'}", "", f"**方面**: {row.get('aspect_norm') or '未知方面'}", f"**簇ID**: {row.get('cluster_id') or '未知'}", f"**优先级**: {row.get('priority') or 'medium'}", "", "**聚类效果参数**:", ""]
    lines += [f"- {label}: {form.format(row[name])}" for name, (label, form) in QUALITIES.items() if row.get(name) is not None]
    terms = _items(row.get("top_terms"))
    lines += [f"- 关键词: {', '.join(map(str, terms[:10]))}"] if terms else []
    lines += ["", f"**摘要**: {row.get('summary') or '无摘要'}", "", "**证据**:", "", *_listed(_items(row.get("evidence_items")), "quote", {"why_representative": "*{}*"}, 5)]
    return [*lines, "", "**建议**:", "", *_listed(_items(row.get("action_items")), "action", {"owner_team": "责任方: {}", "expected_impact": "预期影响: {}"}), ""]


def markdown_report(run: dict, counts: dict, metrics: list[dict], means: dict, clusters: list[dict]) -> str:
    """Report of a run: data, metrics, quality of the clusters, its first clusters (a page of rows), and what to improve.

    run: run_id, pipeline_version, data_slice_id; counts: see COUNTS; metrics: metric_name, metric_scope, shown; means: see
    MEANS; clusters: report rows with report_no. What is missing is left out or shown as N/A.
    """
    lines = ["# 电商评论方面级情感分析报告", "", "## 1. 数据与前提条件", "", f"- **Run ID**: {run['run_id']}", f"- **Pipeline Version**: {run['pipeline_version']}", f"- **Data Slice ID**: {run['data_slice_id']}", "", "### 数据统计", ""]
    lines += [f"- {label}: {counts.get(name) or 0:,}" for name, label in COUNTS.items()]
    lines += ["", "---", "", "## 2. 实验与评估", "", "### 2.1 覆盖率指标", ""]
    named = [[*METRICS.get(m["metric_name"], (m["metric_name"], m.get("notes") or ""))] for m in metrics]
    rows = [[n + (f" ({m['metric_scope']})" if m.get("metric_scope") else ""), m["shown"], remark] for m, (n, remark) in zip(metrics, named, strict=True)]
    lines += _table(["指标名称", "数值", "说明"], rows or [["*暂无评估指标*", "-", "请检查EvaluationAgent是否已执行"]])
    quality = [["簇总数", f"{counts.get('n_clusters') or 0:,}"], ["噪声点数量", f"{counts.get('n_noise') or 0:,}"]]
    quality += [["噪声点比例", f"{(counts.get('n_noise') or 0) / counts['n_valid']:.2%}"]] if counts.get("n_valid") else []
    quality += [[label, form.format(means[name])] for name, (label, form) in MEANS.items() if means.get(name) is not None]
    lines += ["", "### 2.2 聚类效果参数", "", *_table(["参数名称", "数值"], quality), "", "---", "", "## 3. Top 痛点簇", "", "### 3.1 簇概览表", ""]
    shown = lambda r, name, form: form.format(r[name]) if r.get(name) is not None else "N/A"
    over = [[r["report_no"], r.get("cluster_name") or "未命名簇", r.get("aspect_norm") or "未知方面", shown(r, "cluster_size", "{:,}"), shown(r, "neg_ratio", "{:.2%}"), r.get("priority"), shown(r, "confidence", "{:.2f}"), shown(r, "cluster_confidence", "{:.2f}")] for r in clusters]
    lines += _table(["排名", "簇名称", "方面", "簇大小", "负面率", "优先级", "LLM置信度", "聚类置信度"], over)
    lines += ["", "### 3.2 簇详细分析", "", *[line for r in clusters for line in _cluster(r)], "---", "", "## 4. 失败分析与改进方向", "", "### 4.1 数据质量分析", ""]
    ratios = (("候选观点句覆盖率", "n_candidates", "n_sentences"), ("有效抽取率", "n_valid", "n_candidates"), ("噪声点比例", "n_noise", "n_valid"))
    lines += [f"- {label}: {(counts.get(a) or 0) / counts[b]:.2%}" for label, a, b in ratios if counts.get(b)]
    return "\n".join([*lines, "", "### 4.2 改进建议", "", *[f"- {a}" for a in ADVICE], ""])
