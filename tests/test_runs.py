import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import payloads, providers
from reviewloom.sources import schemas, sinks
from reviewloom.streaming.opinions import scored_sentences


def test_run_store(spark, tmp_path):
    store = sinks.RunStore(spark, f"file://{tmp_path}/runs")
    for run, n in (("a", 3), ("b", 2), ("a", 4)):
        store.write(spark.range(n), "cluster_stats", run, pipeline_version="1")
    assert (store.read("cluster_stats", "a").count(), store.read("cluster_stats", "b").count()) == (4, 2)
    store.write(spark.range(1), "cluster_reports", "a")
    store.log("a", ["clustering"], "STARTED")
    assert set(store.clean_from("clustering", "a")) == {"issue_clusters", "cluster_stats", "cluster_reports", "evaluation_metrics"}
    assert store.read("cluster_stats", "b").count() == 2 and store.read("cluster_stats", "a").count() == 0
    assert {r["step_name"]: r["state"] for r in store.state("a").collect()}["clustering"] == "CLEANED"
    with pytest.raises(ValueError):
        store.clean_from("nothing", "a")


def test_steps_run_in_order_and_resume(spark, tmp_path):
    store, seen = sinks.RunStore(spark, f"file://{tmp_path}/runs"), []
    steps = {n: (lambda s, r, n=n: seen.append(n) or 1) for n in "abc"}
    depends = {"c": ["b"], "b": ["a"], "a": []}
    assert store.run_steps("r", steps, depends) == ["a", "b", "c"] == seen
    assert store.run_steps("r", steps, depends, first="b") == ["b", "c"]
    with pytest.raises(ValueError):
        store.run_steps("r", steps, depends, first="x")
    steps["c"] = lambda s, r: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.run_steps("r", steps, depends, first="c")
    assert {r["step_name"]: r["state"] for r in store.state("r").collect()} == {"a": "SUCCESS", "b": "SUCCESS", "c": "FAILED"}


def test_sinks_and_readers(spark, tmp_path):
    df = spark.createDataFrame([(2, "ü,\"x\""), (1, None)], "n int, t string")
    assert sinks.write_csv(df, str(tmp_path / "x.csv"), ["n"]) == 2
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfn,t\r\n1,\r\n2,")
    sinks.write_json({"a": "ü"}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": "ü"}
    assert sinks.read_template("meta\n```\n# head\n\nline one\nline two\n") == "line one\nline two"
    assert sinks.read_template("no mark") == "no mark"
    (tmp_path / "c.yaml").write_text('{"run": {"_secret": 1, "limit": 5}, "_x": 2}')
    assert sinks.read_config(str(tmp_path / "c.yaml")) == {"run": {"limit": 5}}
    assert sinks.run_id("all", "t", datetime(2026, 1, 3, 15, 30)) == "20260103-1530_all_t"
    assert sinks.run_sql(spark, "WITH t AS (SELECT 1 AS x) SELECT x + :y AS z FROM t", {"y": 2}).collect()[0]["z"] == 3
    with pytest.raises(ValueError):
        sinks.run_sql(spark, "DROP TABLE x")
    assert sinks.run_sql(spark, "CREATE OR REPLACE TEMP VIEW made AS SELECT 1 AS x", writes=True).count() == 0 and spark.table("made").count() == 1
    (tmp_path / "s.csv").write_text("original,normalized\n Odor ,SMELL\nodor,scent\n,x\ny, \n", encoding="utf-8")
    assert [tuple(r) for r in sinks.read_synonyms(spark, str(tmp_path / "s.csv")).collect()] == [("odor", "scent")]
    (tmp_path / "n.csv").write_text("term\n Thing\n\nitem\n", encoding="utf-8")
    assert sinks.read_terms(spark, str(tmp_path / "n.csv")) == ["thing", "item"]
    assert sinks.safe_name("a b/c-d_é" + "x" * 60) == ("a_b_c-d_é" + "x" * 60)[:50]


def test_snapshot_and_log(tmp_path):
    source = tmp_path / "c.yaml"
    source.write_text("a: 1")
    folder = sinks.snapshot_config(str(tmp_path / "run"), {"a": 1, "_secret": 2, "p": tmp_path}, "r", "1", source=str(source))
    saved = json.loads((folder / "run_config.json").read_text())
    assert saved["a"] == 1 and "_secret" not in saved and saved["p"] == str(tmp_path) and saved["run_info"]["run_id"] == "r"
    assert (folder / "c.yaml").exists() and "python_version" in json.loads((folder / "environment.json").read_text())
    for _ in range(2):
        logger = sinks.log_to_file(str(tmp_path / "run"), "test-log")
    logger.info("über")
    assert (tmp_path / "run/run.log").read_text(encoding="utf-8").count("über") == 1


def test_declared_tables(spark, tmp_path):
    assert len(schemas.TABLES) == 19 and all(schemas.schema_of(t).names for t in schemas.TABLES)
    df = spark.createDataFrame([("s", "too_short")], "sentence_id string, filter_reason string")
    out = schemas.conform(df, "opinion_candidates")
    assert out.columns == schemas.schema_of("opinion_candidates").names and out.first()["priority_weight"] is None
    with pytest.raises(ValueError, match="not declared"):
        schemas.conform(df.withColumn("extra", F.lit(1)), "opinion_candidates")
    with pytest.raises(ValueError, match="unknown"):
        schemas.schema_of("nothing")
    with pytest.raises(Exception, match="is NULL"):
        schemas.require_declared(spark.createDataFrame([("s", None)], "sentence_id string, is_candidate boolean"), "opinion_candidates").collect()
    store = sinks.RunStore(spark, f"file://{tmp_path}/declared")
    assert store.read("opinion_candidates", "r").count() == 0
    store.write(df, "opinion_candidates", "r", pipeline_version="1", data_slice_id="d")
    store.append(df, "opinion_candidates", "r", pipeline_version="1", data_slice_id="d")
    rows = store.read("opinion_candidates", "r")
    assert rows.count() == 2 and set(rows.columns) == set(out.columns)
    spark.sql("create database if not exists declared")
    try:
        assert len(schemas.create_tables(spark, "declared")) == 19 and schemas.create_tables(spark, "declared") == []
    finally:
        spark.sql("drop database declared cascade")


def test_stages_are_deleted(spark):
    from reviewloom.sources.tables import _WRITTEN, discard, materialize, scratch

    before = set(_WRITTEN)
    with scratch() as keep:
        with scratch() as inner:
            lost, kept = materialize(spark.range(3)), inner(materialize(spark.range(4)))
        both = keep(materialize(kept.union(spark.range(2))))
    assert both.count() == 6 and len(_WRITTEN - before) == 1
    with pytest.raises(Exception):
        lost.count()
    discard(both)
    assert _WRITTEN == before

def test_retries_and_providers(spark):
    calls, pauses = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        providers.retried(fails, 3, 1.0, 2.0, pauses.append)()
    assert len(calls) == 4 and pauses == [1.0, 2.0, 4.0]
    df = spark.createDataFrame([("bad sound",), ("bad sounds",), ("nice color",), ("",), (None,), ("bad sound",)], "t string")
    v = {r["text"]: r["vector"] for r in providers.encode_texts(df, "t").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert len(v) == 4 and dot("bad sound", "bad sounds") > 0.6 > dot("bad sound", "nice color")
    assert len(providers.encode_texts(df, "t", dimensions=8).collect()[0]["vector"]) == 8
    assert [providers.verdict_score(a) for a in ("Yes.", "no", "perhaps", None)] == [0.8, 0.2, 0.5, 0.0]


def test_failed_completions(spark):
    class Broken:
        def complete(self, prompts):
            return ["no json"]

    df = spark.createDataFrame([(1, "p")], "k int, p string")
    assert tuple(providers.complete_prompts(df, "k", "p", Broken, 2).collect()[0])[1:4] == ("FAIL", 2, "ValueError")
    assert providers.complete_prompts(df, "k", "p").collect()[0]["parse_status"] == "SUCCESS"


def test_evidence_spans(spark):
    cases = [("the Lid", "Where is The lid now", 9, 16), ("lid is really broken here", "the lid is really bad, broken", 4, 29), ("nothing", "x y", -1, -1), ("", "x", -1, -1), (None, "x", -1, -1), ("x", None, -1, -1), ("a b c zz", "a b c d", 0, 5)]
    df = spark.createDataFrame(cases, "e string, s string, a int, b int")
    for r in df.select("*", payloads.evidence_span(F.col("e"), F.col("s")).alias("p")).collect():
        assert (r["p"]["start"], r["p"]["end"]) == (r["a"], r["b"]), r


def test_judged_payloads(spark):
    raw = spark.createDataFrame(
        [
            ("r", "s1", json.dumps({"aspects": [{"aspect": "battery life", "issue": "Dies fast", "sentiment": "negative", "evidence_text": "DIES", "sentiment_score": "-0.5"}, {"aspect": "product", "issue": "x", "evidence_text": ""}, {"aspect": "screen", "issue": "dark", "evidence_text": "gone"}]})),
            ("r", "s2", "{broken"),
            ("q", "s1", json.dumps({"aspects": [{"aspect": "cost", "issue": "high"}]})),
        ],
        "run_id string, sentence_id string, llm_output string",
    )
    sentences = spark.createDataFrame([("r", "s1", "It dies fast"), ("r", "s2", "Other")], "run_id string, sentence_id string, target_sentence string")
    valid, issues = payloads.judge_payloads(raw, sentences, fuzzy=False)
    assert [(r["aspect_norm"], r["issue_norm"], r["sentiment_score"]) for r in valid.collect()] == [("battery", "dies fast", -0.5)]
    assert {tuple(r) for r in issues.collect()} == {("r", "s2", "PARSE_FAIL"), ("r", "s1", "EVIDENCE_NOT_FOUND")}


def test_traced_evidence(spark):
    evidence = spark.createDataFrame([("c", 0, "", "the lid"), ("c", 1, "foreign", "q"), ("c", 2, "s2", "q"), ("c", 3, None, "unseen"), ("d", 0, "foreign", "q")], "c string, ordinal int, sentence_id string, quote string")
    samples = spark.createDataFrame([("c", 1, "s1", "Here"), ("c", 2, "s2", "Where is The Lid"), ("d", 1, "s9", "Only one")], "c string, sample_no int, sentence_id string, target_sentence string")
    assert {tuple(r) for r in payloads.trace_evidence(evidence, samples, ["c"]).collect()} == {("c", 0, "s2", "the lid"), ("c", 2, "s2", "q"), ("c", 3, "s1", "unseen"), ("d", 0, "s9", "Only one")}


def test_stream_of_reviews(spark, tmp_path):
    schema = "parent_asin string, user_id string, unix_ts long, rating double, title string, text string, arrived_at timestamp"
    now = datetime(2026, 1, 1)
    rows = [("p", "u", 1, 5.0, "Title", "I love this great battery. It works well", now)] * 2 + [("p", "v", 2, 5.0, None, "tiny", now)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    query = scored_sentences(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("scored_stream").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("scored_stream").select("target_sentence", "is_candidate").collect()
    assert sorted(map(tuple, got)) == [("It works well", False), ("Title I love this great battery", True)]
