import random
import re

import reviewloom.llm.leakage as module
from reviewloom.llm.leakage import leaked_items, matching_windows, reparameterised_items

ITEM = "When Quandry engineers tested twelve hinges they found seven leaks per hundred cycles of the olive drum near Viskerley harbour."
DE = "Ein Bericht über Lacke behauptet dass sechzehn Mängel bis zur Saison verborgen bleiben wenn Prüfer im Amt die Scharniere testen."


def windows(text, n=12):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, items):
    asked = [(i, windows(t)) for i, t in items]
    return {(d, i) for d, t in docs for held in [windows(t)] for i, w in asked if held & w}


DOCS = [
    (1, "Before. " + ITEM + " After."),
    (2, ITEM.upper().replace(" ", "\n")),
    (3, " ".join(ITEM.split()[:11])),
    (4, "text " + " - ".join(ITEM.split()[3:15]) + " text"),
    (5, ITEM.replace("twelve", "fifty").replace("seven", "nine").replace("Quandry", "Viskerley")),
    (6, DE.lower() + " " + "filler " * 50_000),
    (7, None),
    (8, ""),
    (9, "nothing here " * 20),
    (9, "nothing here " * 20),
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = [(1, ITEM), (2, DE), (3, "short one"), (4, None), (5, ITEM)]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leaked_items(docs, df).collect()}
    assert got == brute(DOCS, items) and (4, 1) in got and (6, 2) in got and (3, 1) not in got
    assert leaked_items(docs.limit(0), df).count() == leaked_items(docs, df.limit(0)).count() == 0


def test_exchanged_slots(spark):
    docs = spark.createDataFrame(DOCS[:6], "doc_id long, text string")
    df = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {tuple(r) for r in reparameterised_items(docs, df, window=12).collect()} == {(5, 1)}
    # of eight words, some windows of document 5 are unchanged, so that it holds the item itself
    assert {tuple(r) for r in reparameterised_items(docs, df, window=8).collect()} == set()
    swapped = spark.createDataFrame([(1, ITEM.replace("twelve", "fifty").replace("seven", "nine"))], "doc_id long, text string")
    assert {tuple(r) for r in reparameterised_items(swapped, df, window=12).collect()} == {(1, 1)}


def test_windows_that_a_text_repeats_count_once(spark):
    docs = spark.createDataFrame([(1, "again " * 50_000), (2, "again " * 11), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, "again " * 50_000) for i in range(3)], "item_id long, text string")
    assert matching_windows(docs, items).count() == 3
    assert {tuple(r) for r in leaked_items(docs, items).collect()} == {(1, 0), (1, 1), (1, 2)}


def test_more_windows_than_are_tested_or_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    df = spark.createDataFrame([(1, ITEM), (2, DE), (5, ITEM)], "item_id long, text string")
    few = {tuple(r) for r in leaked_items(docs, df).collect()}, {tuple(r) for r in reparameterised_items(docs, df, window=12).collect()}
    monkeypatch.setattr(module, "PREFILTER_WINDOWS", 2)
    assert few[0] == {tuple(r) for r in matching_windows(docs, df, broadcast_windows=0).select("doc_id", "item_id").distinct().collect()} == brute(DOCS, [(1, ITEM), (2, DE), (5, ITEM)])
    assert few[1] == {tuple(r) for r in reparameterised_items(docs, df, window=12).collect()} and (5, 1) in few[1]


def test_recall_of_planted_exchanges(spark):
    """Passages of made-up items with exchanged numbers, units and names, of 12 words or more, amid other words."""
    rng = random.Random(12)
    syllables = "bra vel tor min dask lor fen quil mar sop tib zan".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 3)))
    vocabulary = [word() for _ in range(400)]
    items, docs, planted = [], [], set()
    for i in range(40):
        slots = ["w"] * rng.randint(14, 22)
        for place in rng.sample(range(1, len(slots)), 4):
            slots[place] = rng.choice(["name", "number", "unit"])
        make = {"w": lambda: rng.choice(vocabulary), "name": lambda: word().capitalize(), "number": lambda: str(rng.randint(2, 9999)), "unit": lambda: rng.choice(module.UNITS)}
        text = [make[s]() for s in slots]
        items.append((i, " ".join([text[0].capitalize(), *text[1:]]) + "."))
        for j in range(3):
            new = {t: make[s]() for s, t in zip(slots, text, strict=True) if s != "w"}
            if len(set(new.values())) < len(new) or set(new.values()) & set(text):
                continue
            filler = " ".join(rng.choices(vocabulary, k=30))
            docs.append((100 * i + j, f"{filler}. {' '.join(new.get(t, t) for t in text)} {filler}."))
            planted.add((100 * i + j, i))
    docs += [(10_000 + i, " ".join(rng.choices(vocabulary, k=60))) for i in range(60)]
    found = {tuple(r) for r in reparameterised_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(found & planted) >= 0.9 * len(planted) and len(planted) > 60 and not found - planted


def test_exchange_for_a_name_that_no_item_holds(spark):
    item = "Orvask coatings made by Quandry engineers keep twelve hinges dry although this is also a word near Viskerley harbour."
    new = item.replace("Orvask", "Bellwick").replace("Quandry", "Tamsin").replace("Viskerley", "Dunmore")
    other = item.replace("coatings", "paints").replace("keep", "hold").replace("dry", "wet").replace("also", "just").replace("near", "at")
    docs = [(1, new), (2, new.lower()), (3, new.upper()), (4, item), (5, item.replace("Quandry", "some")), (6, other), (7, item.replace("Quandry", "Tamsin")), (9, None), (10, "Say: " + new)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, "A quandry is no name here")], "item_id long, text string")
    assert {r["doc_id"] for r in reparameterised_items(df, items, window=19).collect()} == {1, 2, 3, 7, 10}
    assert reparameterised_items(df, items.limit(0)).count() == reparameterised_items(df.limit(0), items).count() == 0


def test_windows_meet_by_template_and_differ_by_slots(spark):
    other = ITEM.replace("twelve", "fifty").replace("seven", "nine").replace("cycles", "kg").replace("Quandry", "Viskerley")
    texts = [(1, ITEM.replace("cycles", "days")), (2, other)]
    found = matching_windows(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(texts, "item_id long, text string")).collect()
    hashes = {pair: {r["hash"] for r in found if (r["doc_id"], r["item_id"]) == pair} for pair in {(r["doc_id"], r["item_id"]) for r in found}}
    assert set(hashes) == {(1, 1), (2, 2)} and hashes[1, 1] == hashes[2, 2] and len(hashes[1, 1]) == 9


def test_windows_of_equal_hashes_are_compared_word_by_word(spark, monkeypatch):
    monkeypatch.setattr(module.F, "xxhash64", lambda *columns: module.F.lit(7).cast("long"))
    items = [(1, ITEM), (2, DE), (3, DOCS[4][1])]
    docs, df = spark.createDataFrame([d for d in DOCS if d[0] != 6] + [(6, DE.lower())], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for broadcast_windows in (module.BROADCAST_WINDOWS, 0):
        got = {tuple(r) for r in matching_windows(docs, df, broadcast_windows=broadcast_windows).select("doc_id", "item_id").distinct().collect()}
        assert got == brute(DOCS, items) and {(5, 3), (6, 2)} <= got
