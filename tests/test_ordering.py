import random

from pyspark.sql import functions as F

from reviewloom.functions.text import between_seconds, epoch_seconds
from reviewloom.operators import payloads, reports, selection
from reviewloom.operators.ordering import dense_ranks, numbered
from reviewloom.sources import sinks


def test_places_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, x int, i int")
    got = {r["i"]: r["n"] for r in numbered(df, ["s"], ["x", "i"], "n").collect()}
    want = {}
    for scope in ("a", "b", None):
        want |= {i: n for n, (_, i) in enumerate(sorted((x, i) for s, x, i in rows if s == scope), 1)}
    assert got == want
    assert sorted(r["n"] for r in numbered(df, [], [F.desc("i")], "n", 0).collect()) == list(range(500))
    assert numbered(df.limit(0), ["s"], ["x"], "n").count() == 0


def test_dense_ranks(spark):
    df = spark.createDataFrame([(5,), (2,), (5,), (9,)], "x int")
    assert {r["x"]: r["r"] for r in dense_ranks(df, ["x"], "r").collect()} == {2: 0, 5: 1, 9: 2}


def test_times_in_two_units(spark):
    cases = [(1_700_000_000, True), (1_700_000_000_999, True), (1_700_000_001_000, False), (1_699_999_999, False), (1_699_999_999_999, False), (None, False), (-5, False)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t long")
    got = df.select("t", between_seconds(F.col("t"), 1_700_000_000, 1_700_000_000).alias("hit"), epoch_seconds(F.col("t")).alias("s")).collect()
    assert {r["t"]: bool(r["hit"]) for r in got} == dict(cases)
    assert {r["t"]: r["s"] for r in got}[1_700_000_000_999] == 1_700_000_000


def test_slices_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("p", "a", "u", 5, 1.0, True, 1, "t", "x")], "parent_asin string, asin string, user_id string, unix_ts long, rating double, verified_purchase boolean, helpful_vote int, title string, text string").write.parquet(f"{tmp_path}/r")
    meta = spark.createDataFrame([("p", "t", "Home")], "parent_asin string, title string, main_category string")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = selection.select_reviews(spark.read.parquet(f"{tmp_path}/r"), meta, selection.Slice(parent_asin="p", first_ts=1, last_ts=9))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(parent_asin,p)" in plan and "GreaterThanOrEqual(unix_ts,1)" in plan


def test_busy_sentences_and_new_opinions(spark):
    rows = [("r", "s1", "a", f"i{n}", "VALID") for n in range(11)] + [("r", "s2", "a", f"i{n}", "VALID") for n in range(10)] + [("r", "s2", "a", "z", "NOISE")]
    valid = spark.createDataFrame(rows, "run_id string, sentence_id string, aspect_norm string, issue_norm string, validity_label string")
    assert [tuple(r) for r in reports.busy_sentences(valid).collect()] == [("r", "s1", 11)]
    judged = spark.createDataFrame([("r", "s1", "a", "i1"), ("r", "s2", "a", "z"), ("q", "s1", "a", "i1")], "run_id string, sentence_id string, aspect_norm string, issue_norm string")
    assert {tuple(r) for r in payloads.new_opinions(judged, valid).collect()} == {("r", "s2", "a", "z"), ("q", "s1", "a", "i1")}


def test_payloads_without_a_record(spark):
    good = '{"aspects": [{"aspect": "battery", "issue": "dies", "evidence_text": "x"}]}'
    texts = [good, f"Here:\n```json\n{good}\n```", '"just text"', "[1, 2]", "", None, "{broken"]
    raw = spark.createDataFrame([("r", f"s{i}", t) for i, t in enumerate(texts)], "run_id string, sentence_id string, llm_output string")
    sentences = spark.createDataFrame([("r", f"s{i}", "X y") for i in range(len(texts))], "run_id string, sentence_id string, target_sentence string")
    valid, issues = payloads.judge_payloads(raw, sentences, fuzzy=False)
    assert {r["sentence_id"] for r in valid.collect()} == {"s0", "s1"}
    assert {tuple(r) for r in issues.collect()} == {("r", f"s{i}", "PARSE_FAIL") for i in range(2, 7)}


def test_log_states(spark):
    log = spark.createDataFrame([("r", "a", "STARTED", None, None, 1), ("r", "a", "SUCCESS", 3, None, 2), ("r", "b", "STARTED", None, None, 3), ("q", "a", "FAILED", None, "e", 4), (None, "a", "X", None, None, 5)], "run_id string, step_name string, state string, output_rows long, error string, logged_at int")
    assert ("r", "a", "SUCCESS", 3, None) in {tuple(r) for r in sinks.latest_states(log).collect()}
    assert {(r["run_id"], r["step_name"]) for r in sinks.without_steps(log, "r", ["a"]).collect()} == {("r", "b"), ("q", "a"), (None, "a")}
