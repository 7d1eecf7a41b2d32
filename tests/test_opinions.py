"""Operators of the lexicon pipeline against plain Python and known answers."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import lexicons as lx
from reviewloom.functions.text import slice_id
from reviewloom.operators import extraction, normalize, opinion, selection
from reviewloom.operators.selection import EmptySelection, Slice

SENTENCES = [
    "I really love this battery, it works great!",
    "The screen is too dark and not good enough",
    "It stopped working after two weeks",
    "You should try something better than this",
    "Nothing to see",
    "short",
    "x" * 501,
    "Das ist très élégant, aber so öde",
    "I've been using it for months and would recommend it",
    "Why would anyone buy this awful, awful thing?",
    "été so bon",
    None,
]


def plain_score(text):
    if text is None or len(text) < 10:
        return 0.0, "too_short"
    if len(text) > 500:
        return 0.0, "too_long"
    s, score, reasons = text.lower(), 0.0, []
    for name, words, points, most in opinion.LISTS:
        n = sum(w in s for w in words)
        if n:
            score += min(n * points, most)
            reasons.append(f"{name}({n})")
    negation, degree = any(w in s for w in lx.NEGATION), any(w in s for w in lx.INTENSITY)
    if negation:
        score += 1.5 if degree else 0.5
        reasons.append("negation_intensity" if degree else "negation")
    if "!" in text:
        score += 0.5
        reasons.append("exclamation")
    tests = {
        "suggestion_pattern": (1.5, r"\b(should|would|could|might)\s+\w+"),
        "recommendation_pattern": (1.5, r"\b(recommend|suggest|advise)\s+\w+"),
        "expectation_pattern": (1.0, r"\b(wish|hope|expect)\s+\w+"),
        "comparison_pattern": (1.0, r"\b(better|worse|best|worst)\s+than"),
        "intensity_pattern": (1.0, r"\b(too|so|very|extremely)\s+\w+"),
        "negation_evaluation_pattern": (1.5, r"\b(not|never)\s+\w+\s+(enough|good|bad)"),
        "time_experience_pattern": (1.0, r"\b(after|since)\s+\w+\s+(months?|years?|days?|weeks?)"),
        "continuous_experience_pattern": (1.0, r"\b(been|have been|has been)\s+\w+ing"),
    }
    hit = [n for n, (_, p) in tests.items() if re.search(p, s)]
    score += sum(tests[n][0] for n in hit)
    if hit:
        reasons.append(f"patterns({','.join(hit[:3])})")
    if re.search(r"\b(i|my|me|we|our)\b", s):
        score += 0.5
        reasons.append("first_person")
    if "?" in text:
        score += 0.3
        reasons.append("question")
    return round(score, 4), "+".join(reasons) or "no_opinion_signal"


def test_scores_match_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "n int, target_sentence string")
    for r in opinion.score_sentences(df).collect():
        assert (r["priority_weight"], r["filter_reason"]) == plain_score(r["target_sentence"]), r
        assert r["is_candidate"] == (r["priority_weight"] >= 2.0)
    assert opinion.score_sentences(df.limit(0)).count() == 0


def test_reviews_are_selected_and_keyed(spark):
    reviews = spark.createDataFrame(
        [("p1", "a1", "u", 5, 4.0, True, 1, "T", "x" * 150), ("p1", "a2", "u", 5, 4.0, True, 1, "T", "x" * 150), ("p2", None, None, None, 1.0, None, None, None, None), ("p3", "a", "u", 9, 2.0, False, 7, "", "y")],
        "parent_asin string, asin string, user_id string, unix_ts long, rating double, verified_purchase boolean, helpful_vote int, title string, text string",
    )
    meta = spark.createDataFrame([("p1", "B", "Home"), ("p1", "A", "Home"), ("p3", "C", None)], "parent_asin string, title string, main_category string")
    once = {r["parent_asin"]: r for r in selection.distinct_reviews(reviews).collect()}
    assert once["p1"]["asin"] == "a1" and once["p1"]["review_pk"] == hashlib.md5(("p1|u|5|T|" + "x" * 100).encode()).hexdigest()
    assert once["p2"]["review_pk"] == hashlib.md5(b"p2||||").hexdigest()
    assert selection.select_reviews(reviews, meta).count() == 4  # the product listed twice gives its review twice
    assert selection.select_reviews(reviews, meta, Slice(category="Home")).count() == 2
    assert [r["parent_asin"] for r in selection.select_reviews(reviews, meta, Slice(verified=False)).collect()] == ["p3"]
    assert selection.select_reviews(reviews, meta, Slice(first_ts=6, last_ts=9, min_helpful=7)).count() == 1
    assert selection.select_reviews(reviews, meta, Slice(limit=1)).count() == 1
    with pytest.raises(EmptySelection):
        selection.require_rows(selection.select_reviews(reviews, meta, Slice(parent_asin="none")))


def test_cleaning_and_sentences(spark):
    df = spark.createDataFrame([("k", "p", 1, 5.0, " Good buy ", "It  works<br>well. Really!  ok? The second one.\nfailed"), ("n", "p", 1, 5.0, None, "tiny"), ("e", "p", 1, 5.0, "", None)], "review_pk string, parent_asin string, unix_ts long, rating double, review_title string, review_text string")
    rows = selection.normalize_reviews(df).collect()
    assert [(r["review_pk"], r["clean_text"], r["cleaning_flags"]) for r in rows] == [("k", "Good buy It workswell. Really! ok? The second one. failed", None)]
    out = selection.build_sentences(selection.normalize_reviews(df)).orderBy("sentence_index").collect()
    assert [r["target_sentence"] for r in out] == ["Good buy It workswell", "Really", "The second one", "failed"]
    assert out[1]["context_text"] == "Good buy It workswell Really The second one" and out[0]["prev_sentence"] is None and out[3]["next_sentence"] is None
    bare = selection.build_sentences(selection.normalize_reviews(df), 0).collect()
    assert {r["context_text"] == r["target_sentence"] for r in bare} == {True}


def test_slice_ids():
    assert slice_id(None, None, None, None) == "default"
    assert slice_id("Home", None, None, None) != slice_id(None, "Home", None, None)
    assert slice_id("a", "b", "1-2", {"y": 1, "x": 2}) == slice_id("a", "b", "1-2", {"x": 2, "y": 1})
    assert len(slice_id("a", None, None, None)) == 12


def extract(spark, sentence, context=None, title=None):
    df = spark.createDataFrame([("s", sentence, context or sentence, title, None)], "sentence_id string, target_sentence string, context_text string, product_title string, features_short string")
    return {r["aspect_raw"]: r for r in extraction.extract(df).collect()}


def test_extraction(spark):
    got = extract(spark, "The battery life is so great")
    assert got["the battery life"]["sentiment"] == "positive" and got["the battery life"]["issue_raw"] == "so great"
    cut = extract(spark, "The battery life is really great")  # 15 characters behind the aspect are read
    assert cut["the battery life"]["issue_raw"] == "really grea"
    swapped = extract(spark, "The screen is not good")["the screen is"]
    assert swapped["sentiment"] == "negative" and swapped["issue_raw"] == "not good"
    assert extract(spark, "The size of the box") == {}  # no word of sentiment anywhere near
    mixed = extract(spark, "good price but bad design")
    assert {r["sentiment"] for r in mixed.values()} == {"neutral"} and {r["sentiment_score"] for r in mixed.values()} == {0.5}
    assert "price" in extract(spark, "I love it so much", "The price was low I love it so much")
    long = "love the sound " + "x" * 200
    assert len(extract(spark, long)["the sound " + "x" * 200]["evidence_text"]) == 100


def test_degree_words_change_nothing(spark):
    a, b = extract(spark, "The sound is good or bad or bad"), extract(spark, "The sound is very good or bad or bad")
    assert {r["sentiment"] for r in a.values()} == {r["sentiment"] for r in b.values()}


@pytest.mark.parametrize("aspect, want", [("shipping", "delivery"), (" Battery Life ", "battery"), ("screen quality", "display"), ("screen", "display"), ("display", "screen"), ("batteri", "battery"), ("long battery life", "battery"), ("quality of material", "quality"), ("Unheard Of", "unheard of"), ("", ""), (None, "")])
def test_cascade(spark, aspect, want):
    df = spark.createDataFrame([(aspect,)], "aspect_raw string")
    assert normalize.normalize_aspects(df).collect()[0]["aspect_norm"] == want


def test_validity(spark):
    cases = [("battery", "drains fast", "VALID"), ("screen", "stopped working", "VALID"), ("product", "good", "NOISE"), ("battery", "good", "NOISE"), ("", "x", "INVALID"), ("battery", "", "INVALID"), (None, "x", "INVALID"), ("this thing", "x y", "NOISE"), (" IT ", "x y", "NOISE")]
    df = spark.createDataFrame(cases, "a string, i string, want string")
    assert all(r["got"] == r["want"] for r in df.select("*", normalize.validity(F.col("a"), F.col("i")).alias("got")).collect())


def test_conflicts_and_evidence(spark):
    df = spark.createDataFrame([(5.0, "negative", "RATING_CONFLICT"), (1.0, "positive", "RATING_CONFLICT"), (3.0, "negative", None), (None, "negative", None), (5.0, None, None)], "r double, s string, want string")
    assert all(r["got"] == r["want"] for r in df.select("*", normalize.rating_conflict(F.col("r"), F.col("s")).alias("got")).collect())
    df = spark.createDataFrame([("BROKE", "it broke", True), ("", "x", True), (None, "x", True), ("y", "x", False)], "e string, s string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("*", normalize.evidence_found(F.col("e"), F.col("s")).alias("got")).collect())


def test_synonyms_from_a_table(spark, monkeypatch):
    entries = spark.createDataFrame([(" Odor", "SMELL "), ("odor", "scent"), ("", "x"), ("y", None), ("b c", "d")], "original string, normalized string")
    assert list(normalize.synonyms_of(entries).items()) == [("b c", "d"), ("odor", "smell")]
    df = spark.createDataFrame([("ODOR",), ("the b c",)], "aspect_raw string")
    got = {r["aspect_raw"]: (r["aspect_norm"], r["method"]) for r in normalize.normalize_aspects(df, normalize.synonyms_of(entries), fuzzy=False).collect()}
    assert got == {"ODOR": ("smell", "exact"), "the b c": ("d", "keyword")}
    monkeypatch.setattr(normalize, "MAX_SYNONYMS", 1)
    with pytest.raises(ValueError):
        normalize.synonyms_of(entries)


def test_extraction_needs_no_shuffle(spark):
    df = spark.createDataFrame([("s", "The battery is great", "The battery is great", None, None)], "sentence_id string, target_sentence string, context_text string, product_title string, features_short string")
    plan = extraction.extract(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_two_stage_gate(spark):
    from reviewloom.operators.kernels import worth_two_stages

    rows = spark.range(202).select((F.col("id") % 2).alias("b"))
    assert worth_two_stages(rows, "b") and not worth_two_stages(rows.limit(200), "b") and not worth_two_stages(rows.limit(0), "b")
