import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import reviewloom.operators.flatten as flatten
from reviewloom.operators.flatten import flatten_nested


def rows(df):
    return {(r["k"], r["list_name"], r["item_path"]) for r in df.collect()}


PAYLOADS = [
    ("plain", '{"aspects": [{"aspect": "a", "evidence_spans": [{"start": 1}, null, {"start": 2}]}, null, "bare"], "extraction_warnings": ["w"]}'),
    ("object", '{"aspects": {"aspect": "b", "evidence_spans": []}}'),
    ("wrapped", '{"data": {"output": {"aspects": [{"aspect": "c"}]}, "usage": {"steps": 2}}}'),
    ("string", json.dumps('{"aspects": [{"aspect": "d"}]}')),
    ("fenced", 'Here:\n```json\n{"result": {"aspects": [{"aspect": "é"}]}}\n```'),
    ("inner string", '{"aspects": "[{\\"aspect\\": \\"f\\"}]"}'),
    ("broken", '{"aspects": [{"aspect"'),
    ("empty", ""),
    ("null", None),
    ("nulls", '{"aspects": null, "extraction_warnings": [null]}'),
]
FIELDS = ("aspects", "extraction_warnings", "sentence_id")


def test_every_shape_of_payload(spark):
    df = spark.createDataFrame(PAYLOADS, "k string, payload string")
    assert rows(flatten_nested(df, "payload", ["k"], FIELDS)) == {
        ("plain", "aspects", "0"),
        ("plain", "aspects", "2"),
        ("plain", "aspects.evidence_spans", "0.0"),
        ("plain", "aspects.evidence_spans", "0.2"),
        ("plain", "extraction_warnings", "0"),
        ("object", "aspects", "0"),
        ("wrapped", "aspects", "0"),
        ("string", "aspects", "0"),
        ("fenced", "aspects", "0"),
        ("inner string", "aspects", "0"),
    }


def test_fields_and_parent_links(spark):
    df = spark.createDataFrame(PAYLOADS, "k string, payload string")
    out = flatten_nested(df, "payload", ["k"], FIELDS, fields=["aspect", "start"], with_value=True)
    got = {(r["k"], r["list_name"], r["item_path"]): r for r in out.collect()}
    assert got["fenced", "aspects", "0"]["aspect"] == "é"
    span = got["plain", "aspects.evidence_spans", "0.2"]
    assert (span["start"], span["parent_path"], span["ordinal"]) == ("2", "0", 2)
    assert got["plain", "aspects", "2"]["value"] == "bare" and got["plain", "aspects", "2"]["aspect"] is None


def test_payload_that_is_a_list(spark):
    data = [("a", '[{"action": "x", "plan": {"steps": [{"s": 1}, {"s": 2}]}}, "bare", null]'), ("b", '{"action": "y", "plan": "none"}'), ("c", json.dumps('[{"action": "z"}]')), ("d", "[]"), ("e", "[null]"), ("f", None)]
    df = spark.createDataFrame(data, "k string, items string")
    assert rows(flatten_nested(df, "items", ["k"], root_list="items")) == {
        ("a", "items", "0"),
        ("a", "items", "1"),
        ("a", "items.plan.steps", "0.0"),
        ("a", "items.plan.steps", "0.1"),
        ("b", "items", "0"),
        ("c", "items", "0"),
    }


def test_declared_list_keeps_its_level(spark):
    df = spark.createDataFrame([("a", '{"aspects": {"spans": [1]}}')], "k string, payload string")
    assert rows(flatten_nested(df, "payload", ["k"], ["aspects"], declared=["aspects", "aspects.spans"])) == {("a", "aspects", "0"), ("a", "aspects.spans", "0.0")}


def test_empty_table_extra_columns_and_clashes(spark):
    empty = spark.createDataFrame([], "k string, payload string, value int")
    assert flatten_nested(empty, "payload", ["k"], FIELDS).count() == 0
    df = spark.createDataFrame([("a", '{"aspects": [1]}', 7), ("a", '{"aspects": [1]}', 7)], "k string, payload string, value int")
    assert flatten_nested(df, "payload", ["k"], FIELDS).count() == 2  # repeated rows stay
    with pytest.raises(ValueError):
        flatten_nested(df, "payload", ["value"], FIELDS)


def nested(levels):
    text = '"x"'
    for _ in range(levels):
        text = f'{{"l": [{text}, null]}}'
    return text


@pytest.mark.parametrize("levels", [3, 25, 900])
def test_every_level_of_a_deep_payload(spark, levels):
    df = spark.createDataFrame([("a", nested(levels))], "k string, payload string")
    got = rows(flatten_nested(df, "payload", ["k"]))
    assert got == {("a", ".".join(["l"] * (n + 1)), ".".join(["0"] * (n + 1))) for n in range(levels)}


def test_many_encodings_and_wrappers(spark):
    text = '{"aspects": [{"aspect": "a"}]}'
    for _ in range(6):
        text = json.dumps(text)
    wrapped = '{"aspects": [{"aspect": "b"}]}'
    for i in range(9):
        wrapped = f'{{"w{i}": {wrapped}}}'
    df = spark.createDataFrame([("text", text), ("object", wrapped)], "k string, payload string")
    assert rows(flatten_nested(df, "payload", ["k"], FIELDS)) == {("text", "aspects", "0"), ("object", "aspects", "0")}


def test_lists_inside_lists(spark):
    df = spark.createDataFrame([("a", '{"l": [[{"m": [1]}, null, 2], 3, []]}')], "k string, payload string")
    assert rows(flatten_nested(df, "payload", ["k"])) == {("a", "l", "0"), ("a", "l", "1"), ("a", "l", "2"), ("a", "l.[]", "0.0"), ("a", "l.[]", "0.2"), ("a", "l.[].m", "0.0.0")}


def test_very_long_and_deep_payloads(spark):
    long = json.dumps({"aspects": [{"aspect": "x" * 10} for _ in range(20_000)]})
    deep = '{"aspects": [1, ' + '{"a": [' * 3000 + "]}" * 3000 + "]}"
    df = spark.createDataFrame([("long", long), ("deep", deep)], "k string, payload string")
    assert flatten_nested(df, "payload", ["k"], FIELDS).where("k = 'long'").count() == 20_000
    out = {(r["list_name"], r["item_path"]): r["value"] for r in flatten_nested(df.where("k = 'deep'"), "payload", ["k"], FIELDS, with_value=True).where("list_name = 'aspects' or item_path like '1.0.0.0'").collect()}
    assert out["aspects", "1"] == '{"a": [' * 3000 + "]}" * 3000 and set(out) == {("aspects", "0"), ("aspects", "1"), ("aspects.a.a.a", "1.0.0.0")}


def test_too_many_fields_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(flatten, "MAX_FIELDS", 5)
    df = spark.createDataFrame([("a", json.dumps({f"k{i}": i for i in range(9)}))], "k string, payload string")
    with pytest.raises(ValueError, match="fields"):
        flatten_nested(df, "payload", ["k"])


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False) | st.text() | st.integers(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4)))
def test_deep_reader_and_writer_agree_with_the_plain_ones(value):
    text = json.dumps(value, indent=1)
    assert flatten._loads_deep(text) == value and flatten._dumps_deep(value) == json.dumps(value, ensure_ascii=False)


@pytest.mark.parametrize("text", ["", "[", "{", "[1,]", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "1 2", "]", "{]", "[}", "nul", '{1: 2}', ",", "[,1]"])
def test_deep_reader_refuses_what_is_no_json(text):
    with pytest.raises(ValueError):
        flatten._loads_deep(text)
