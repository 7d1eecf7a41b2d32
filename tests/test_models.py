"""Providers, prompts, the semantic and model strategies, insights, and a whole run on a small store."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F


from reviewloom.operators import normalize, providers, reports
from reviewloom.pipeline import RunConfig, run_pipeline, table_name
from reviewloom.sources import report, schemas, sinks


def test_configuration_of_models():
    config = {"models": {"llm_model": "m0", "extraction_llm": {"provider": "openai", "model": "m1", "api_key": "k"}, "insight_llm": {"model": "m2"}}}
    assert providers.model_config(config, "extraction", {}) == providers.ModelConfig("openai", "m1", 0.0, None, "k")
    assert providers.model_config(config, "insight", {}).temperature == 0.3
    assert providers.model_config(config, "judge", {}).model == "m0"
    assert providers.model_config(config, "extraction", {"X_LLM_MODEL": "m9"}, "X_").model == "m9"
    assert providers.model_config({}, env={"LLM_MODEL": "e"}).model == "e"
    assert "k" not in repr(providers.model_config(config, "extraction", {}))
    with pytest.raises(ValueError):
        providers.build_completer(providers.ModelConfig("nobody"))
    with pytest.raises(ValueError):
        providers.ChatModel(providers.ModelConfig("nobody"))


class Server(BaseHTTPRequestHandler):
    def _answer(self, body):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        self._answer({"models": [{"name": "m:latest"}]})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        answers = {
            "/api/chat": lambda: {"message": {"content": asked["messages"][0]["content"].upper()}},
            "/chat/completions": lambda: {"choices": [{"message": {"content": self.headers["Authorization"]}}]},
            "/api/embeddings": lambda: {"embedding": [float(len(asked["prompt"])), 1.0]},
            "/api/rerank": lambda: {"results": [{"relevance_score": 0.5 if asked["query"] == asked["documents"][0] else 0.1}]},
        }
        self._answer(answers[self.path]())

    def log_message(self, *_):
        pass


def test_connectors_over_http():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        chat = providers.ChatModel(providers.ModelConfig("ollama", "m", base_url=url))
        assert chat.complete(["a", "b"]) == ["A", "B"] and chat.healthy() and not providers.served(url, "other")
        assert providers.ChatModel(providers.ModelConfig("openai", "m", base_url=url, api_key="k")).complete(["a"]) == ["Bearer k"]
        assert providers.HttpEmbedder("m", url).encode(["abc", ""]).tolist() == [[3.0, 1.0], [0.0, 1.0]]
        assert providers.HttpReranker("m", url).score([("a", "a"), ("a", "b")]) == [0.5, 0.1]
    finally:
        server.shutdown()
    assert not providers.served("http://127.0.0.1:1", "m")


def test_rerankers_in_order():
    class Fails:
        def score(self, pairs):
            raise OSError

    class Says:
        def complete(self, prompts):
            return ["Yes" if "alike" in p else "no idea" if "odd" in p else None for p in prompts]

    fall = providers.FirstWorking([Fails(), providers.VerdictReranker(Says())])
    assert fall.score([("alike", "x"), ("odd", "x"), ("z", "x")]) == [0.8, 0.2, 0.0]
    with pytest.raises(OSError):
        providers.FirstWorking([Fails()]).score([("a", "b")])


def test_a_failed_reranker_is_no_score(spark, monkeypatch):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "x string, y string")
    monkeypatch.setattr(providers, "retried", lambda call: call)  # without pauses

    class Answers:
        def __init__(self, values):
            self.values = values

        def score(self, pairs):
            if self.values is None:
                raise OSError("the server is gone")
            return self.values[: len(pairs)]

    for values in (None, [], [0.5], [0.5, float("nan")], [0.5, None]):
        with pytest.raises(Exception, match="server is gone|pairs|NoneType"):
            providers.rerank(df.coalesce(1), "x", "y", lambda v=values: Answers(v)).collect()
    assert sorted(r["rerank_score"] for r in providers.rerank(df.coalesce(1), "x", "y", lambda: Answers([1.0, 0.5])).collect()) == [0.5, 1.0]
    with pytest.raises(ValueError):
        providers.FirstWorking([])


def test_structured_answers():
    good = '{"has_opinion": true, "aspects": [{"aspect": "a", "sentiment": "s", "issue": "i", "evidence_text": "e", "sentiment_score": "0.5"}]}'
    out = providers.structured_extraction(f"Sure:\n```json\n{good}\n```")
    assert out["language"] == "en" and out["aspects"][0]["sentiment_score"] == 0.5 and out["aspects"][0]["confidence"] == 0.5
    for bad in ("none", "[1]", "{}", '{"has_opinion": "yes"}', '{"has_opinion": true, "aspects": [{"aspect": "a"}]}', '{"has_opinion": true, "aspects": {}}', None):
        with pytest.raises(ValueError):
            providers.structured_extraction(bad)
    shown = providers.with_example("p", providers.NORMALIZATION_FIELDS)
    assert shown.startswith("p\n\n") and json.loads(shown[shown.index("{") :]).keys() == providers.NORMALIZATION_FIELDS.keys()


def test_templates(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(providers.fill_template("{a}-{b}-{{c}}", df.columns)).first()[0] == "x--{c}"
    with pytest.raises(ValueError):
        providers.fill_template("{zz}", df.columns)


def test_semantic_matches_against_brute_force(spark):
    vocabulary = sorted({"battery life", "sound", "price"})
    asked = ["battery lives", "the sounds", "unrelated thing", "price", ""]
    coder = providers.HashedNgrams()
    scores = np.round(coder.encode(asked) @ coder.encode(vocabulary).T, 9)
    want = {a: vocabulary[s.argmax()] for a, s in zip(asked, scores, strict=True) if s.max() >= 0.6}
    df = spark.createDataFrame([(a,) for a in asked] * 2, "a string")
    got = normalize.semantic_matches(df, vocabulary, threshold=0.6).collect()
    assert {r["a"]: r["term"] for r in got} == want and len(got) == len(want) >= 2
    assert normalize.semantic_matches(df, []).count() == 0


def test_strategies_in_order_and_growth(spark):
    synonyms = {"shipping": "delivery", "sound": "audio"}
    df = spark.createDataFrame([(a,) for a in ("shipping", "deliverys", "audible", "charging speed", "stuff", None)], "aspect_raw string")
    names, growth = normalize.normalize_with_models(df, synonyms, fuzzy=False, embed=providers.HashedNgrams, complete=normalize.PrefixNormalizer, semantic_threshold=0.75)
    got = {r["aspect_raw"]: (r["aspect_norm"], r["method"]) for r in names.collect()}
    assert got == {"shipping": ("delivery", "exact"), "deliverys": ("delivery", "semantic"), "audible": ("audio", "llm"), "charging speed": ("charging speed", "llm"), "stuff": ("stuff", "llm_noise"), None: ("", "empty")}
    grown = {r["original"]: r["normalized"] for r in growth.collect()}
    assert grown == {"charging speed": "charging speed"}
    again = normalize.normalize_with_models(df, synonyms | grown, fuzzy=False, complete=normalize.PrefixNormalizer)
    assert {r["aspect_raw"]: r["method"] for r in again[0].collect()}["charging speed"] == "exact" and again[1].count() == 0
    plain = normalize.normalize_with_models(df, synonyms, fuzzy=False)[0].collect()
    assert {r["method"] for r in plain} == {"exact", "none", "empty"}


def test_repaired_insights():
    answer = {"summary": "s", "priority": "urgent", "evidence_items": ["quote", {"text": "older"}, {"sentence_id": "s1", "quote": "q", "why_representative": "w"}, {"quote": ""}, 5], "action_items": [{"suggestion": "do", "urgency": "high"}, "act", {}], "confidence": 1}
    out = reports.repair_insight("Here: " + json.dumps(answer))
    assert (out["cluster_name"], out["summary"], out["priority"], out["confidence"]) == (reports.UNNAMED, "s", "medium", 1.0)
    assert [(e["sentence_id"], e["quote"]) for e in out["evidence_items"]] == [("", "quote"), ("", "older"), ("s1", "q")]
    assert [a["action"] for a in out["action_items"]] == ["do", "act"]
    with pytest.raises(ValueError):
        reports.repair_insight("nothing")


def test_report_text():
    row = {"report_no": 1, "cluster_name": "n", "aspect_norm": "a", "cluster_id": "3", "priority": "high", "cluster_size": 1234, "neg_ratio": 0.5, "confidence": 0.8, "evidence_items": json.dumps([{"quote": "q", "why_representative": "w"}, "bare"]), "action_items": "broken", "top_terms": '["t1", "t2"]', "summary": "sum"}
    text = report.markdown_report({"run_id": "r", "pipeline_version": "1", "data_slice_id": "d"}, {"n_reviews": 1234, "n_valid": 10, "n_noise": 1, "n_candidates": 20, "n_sentences": 40}, [{"metric_name": "valid_rate", "metric_scope": "overall", "shown": "5.00%"}, {"metric_name": "x", "shown": "1"}], {"mean_cohesion": 2.0}, [row, {"report_no": 2}])
    for part in ("总评论数: 1,234", "| 有效aspect率 (overall) | 5.00% |", "| 1 | n | a | 1,234 | 50.00% | high | 0.80 | N/A |", "- q\n  - *w*\n- bare", "- 详见数据库记录", "关键词: t1, t2", "噪声点比例: 10.00%", "平均紧密度 | 2.0000", "未命名簇"):
        assert part in text, part
    assert "暂无评估指标" in report.markdown_report({"run_id": "r", "pipeline_version": "1", "data_slice_id": "d"}, {}, [], {}, [])


@pytest.mark.parametrize("method", ["lexicon", "model"])
def test_a_whole_run_and_its_resumption(spark, tmp_path, method):
    texts = ["The battery is great and I love it.", "The battery is terrible. Bad battery!", "I hate the screen, it is bad.", "Great price, I really love the price.", "The sound is awful and I hate the sound."]
    rows = [("p" + str(i % 3), f"a{i}", f"u{i}", 1_700_000_000 + i, float(1 + i % 5), True, i, "Title", texts[i % 5] + f" Number {i} here") for i in range(40)]
    reviews = spark.createDataFrame(rows + rows[:3], "parent_asin string, asin string, user_id string, unix_ts long, rating double, verified_purchase boolean, helpful_vote int, title string, text string")
    meta = spark.createDataFrame([(f"p{i}", f"Product {i}", "Home", ["f1", "f2"], "d", "{}") for i in range(3)], "parent_asin string, title string, main_category string, features array<string>, description string, details string")
    folder, out, config = f"file://{tmp_path}/store", str(tmp_path / "out"), RunConfig(method=method, reranker=providers.CosineReranker if method == "lexicon" else None)
    done = run_pipeline(spark, folder, "r1", reviews, meta, config, out)
    assert len(done) == 11
    store = sinks.RunStore(spark, folder)
    read = lambda t: store.read(table_name(config, t), "r1")
    valid, members, stats, made = read("aspect_sentiment_valid"), read("issue_clusters"), read("cluster_stats"), read("cluster_reports")
    assert valid.count() == members.count() > 0 and stats.count() == made.count() > 0
    clustered = members.where("not is_noise")
    assert stats.agg(F.sum("cluster_size")).first()[0] == clustered.count()
    ids = {r["cluster_id"] for r in clustered.select("cluster_id").distinct().collect()}
    assert ids == {r["cluster_id"] for r in stats.collect()} == {str(i) for i in range(len(ids))}
    known = {r["sentence_id"] for r in members.collect()}
    assert all(set(json.loads(r["representative_sentence_ids"])) <= known for r in stats.collect())
    assert all(json.loads(r["action_items"]) for r in made.collect())
    assert {r["metric_name"] for r in read("evaluation_metrics").collect()} == {"candidate_coverage", "extraction_success_rate", "valid_rate", "valid_sentence_rate"}
    for table in ("selected_reviews", "meta_context", "cluster_stats"):
        assert set(read(table).columns) == set(schemas.schema_of(table_name(config, table)).names)
    assert (tmp_path / "out/report.md").read_text(encoding="utf-8").startswith("# ") and len((tmp_path / "out/clusters_and_reviews.csv").read_text(encoding="utf-8-sig").splitlines()) > members.count()
    assert json.loads((tmp_path / "out/clusters_export_summary.json").read_text())["n_records"] == members.count()
    before = valid.count()
    assert run_pipeline(spark, folder, "r1", reviews, meta, config, first="judge")[-1] == "report"
    assert read("aspect_sentiment_valid").count() == before
    with pytest.raises(ValueError):
        run_pipeline(spark, folder, "r1", reviews, meta, config, first="nothing")


def test_empty_slices_fail_and_are_logged(spark, tmp_path):
    reviews = spark.createDataFrame([], "parent_asin string, asin string, user_id string, unix_ts long, rating double, verified_purchase boolean, helpful_vote int, title string, text string")
    meta = spark.createDataFrame([], "parent_asin string, title string, main_category string, features array<string>, description string, details string")
    with pytest.raises(ValueError):
        run_pipeline(spark, f"file://{tmp_path}/s", "r", reviews, meta)
    assert {r["step_name"]: r["state"] for r in sinks.RunStore(spark, f"file://{tmp_path}/s").state("r").collect()} == {"select": "FAILED"}
