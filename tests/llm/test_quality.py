import pytest

from reviewloom.llm.quality import document_statistics, not_prose

TEXTS = {
    "prose": [
        "The kettle broke after a week. I asked for help, but nobody answered! Would I buy it again?",
        "THE KETTLE BROKE. NOBODY ANSWERED, AND I WAS SAD.",
        "The kettle broke after\na week. I asked for\nhelp. It costs 3.50\ndollars.",
        "- The kettle broke after a week.\n- Nobody answered the phone.\n- I would not buy it again.",
        "颜色和图片差别很大，我花了31元。充电要10小时，太慢了！",
        "ใช้งานได้32สัปดาห์แล้วเสีย สีสวยมากแต่ผ้าบางไปหน่อย",
        "وصل الطرد بعد 9 أيام. لماذا لا يغلق الغطاء جيدا؟",
        "Q: Does it work?\nA: It does the job. We like it.\n- red kettle",
    ],
    "list": ["In the box:\n- red kettle x2\n- spare lid\n- blue mat", "1. red kettle\n2. spare lid\n3. blue mat\n4. lamp", "red kettle\nspare lid\nblue mat\nlamp", "red kettle, spare lid, blue mat, lamp, tent x2, drill", "[x] red kettle\n[ ] spare lid", "- 红色水壶\n- 备用盖子\n- 蓝色垫子", "- กาต้มน้ำ\n- ฝาสำรอง\n- เสื่อ", "赤い\n青い\n白い\n黒い"],
    "table": ["price,color,sku\n3.50,red,P1\n4.20,,P2", "price\tcolor\n3.50\tred\n\tblue", "| a | b |\n|---|---|\n| 1 | red |", '"a";"b"\n"1";"red"', "<tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>red</td></tr>", "price     color     sku\n3.50      red       P1\n          blue      P2", "品名|颜色|价格\n水壶|红色|31\n盖子|蓝色|12", "名前\t色\nやかん\t赤"],
    "junk": ["Lp/fY5aMjX5WSI5dOvN2yE2ArnzLJZ9VKOrLhGsK2K5SI3XOQhAgrzMrHfw", "$|@|^$!->|->!^-@>#\n#\n* $$_>#^-!</%", "home menu cart login " * 20, "qwrt zxcvb sdfgh pqrstv bcdfg", "", "   ", None, "0x96be6df2 50ee err=24\n0xc6a953ac 661c err=12\n0x91dcd37b 61f7 err=47"],
}


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(i, t) for i, t in enumerate(x for texts in TEXTS.values() for x in texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    common = spark.createDataFrame([("en", w) for w in "the a i it is and of to in for but not we".split()] + [("en", None)], "lang string, word string")
    return {r["doc_id"]: r for r in document_statistics(docs, common).collect()}


def test_verdicts(verdicts):
    want = [kind for kind, texts in TEXTS.items() for _ in texts]
    assert [verdicts[i]["kind"] for i in range(len(want))] == want


def test_statistics(verdicts):
    r = verdicts[1]
    assert (r["n_words"], r["n_lines"], r["n_sentence_ends"]) == (9, 1, 2)
    assert r["punctuated_line_share"] == 1.0 and r["mean_word_length"] == round(38 / 9, 6) and r["common_word_share"] == round(3 / 9, 6)
    assert "few_sentence_ends" in verdicts[8]["reasons"]


def test_every_failed_rule_is_named_for_prose_too(verdicts, spark):
    assert verdicts[0]["kind"] == "prose" and verdicts[0]["reasons"] == "gopher_word_count"
    assert {"gopher_bullet_lines", "fineweb_short_lines", "few_sentence_ends", "bullet_lines"} <= set(verdicts[9]["reasons"].split(","))
    docs = spark.createDataFrame([(1, "the a ... # … 1 2 3\nand so on..."), (2, "The kettle broke after a week and we asked for help. " * 6)], "doc_id long, text string")
    common = spark.createDataFrame([("en", w) for w in "the a and".split()], "lang string, word string")
    got = {r["doc_id"]: set(filter(None, r["reasons"].split(","))) for r in document_statistics(docs, common).collect()}
    assert {"gopher_symbols_per_word", "gopher_ellipsis_lines", "gopher_alphabetic_words", "gopher_mean_word_length"} <= got[1] and "gopher_stop_words" not in got[1]
    assert not any(rule.startswith(("gopher", "fineweb")) for rule in got[2])


def test_empty_tables_and_long_text(spark):
    docs = spark.createDataFrame([(1, "It works well. " * 20_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "lang string, word string")
    assert document_statistics(docs, none).collect()[0]["kind"] == "prose"
    assert not_prose(docs.limit(0), none).count() == 0


def test_documents_that_are_no_prose_have_the_verdicts_of_the_statistics(spark):
    rows = [(i, t) for i, t in enumerate(x for texts in TEXTS.values() for x in texts)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
    common = spark.createDataFrame([("en", w) for w in "the a i it is and of to in for but not we".split()], "lang string, word string")
    want = {(r["doc_id"], r["kind"]) for r in document_statistics(docs, common).collect() if r["kind"] != "prose"}
    got = [tuple(r) for r in not_prose(docs, common).collect()]
    assert set(got) == want and len(got) == len(want) > 20
