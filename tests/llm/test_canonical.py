import random
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

import reviewloom.llm.canonical as module
from reviewloom.llm.canonical import BKTree, Matcher, bag_distance, closest_order, distance, entry_keys, fillers_of, map_to_entries, reference_entries

WORDS = st.text("abcd", max_size=7)


def test_distance_values():
    assert [distance(*p) for p in (("ca", "abc"), ("", "ab"), ("abcd", "abdc"), ("same", "same"), ("kitten", "sitting"))] == [2, 2, 1, 0, 3]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, WORDS)
def test_distance_is_a_metric(a, b, c):
    assert distance(a, b) == distance(b, a) and (distance(a, b) == 0) == (a == b)
    assert distance(a, c) <= distance(a, b) + distance(b, c)
    assert bag_distance(a, b) == bag_distance(b, a) <= distance(a, b)
    assert bag_distance(a, c) <= bag_distance(a, b) + bag_distance(b, c)


def test_tree_returns_every_entry_within_threshold():
    rng = random.Random(3)
    entries = {"".join(rng.choices("abcde", k=rng.randint(1, 8))) for _ in range(400)}
    tree = BKTree(entries)
    for _ in range(60):
        q, t = "".join(rng.choices("abcde", k=rng.randint(1, 8))), rng.randint(0, 3)
        assert sorted(tree.within(q, t)) == sorted((distance(q, e), e) for e in entries if distance(q, e) <= t)


def matcher(entries):
    return Matcher(entry_keys(entries), fillers_of(o for o, _ in entries))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=3), min_size=1, max_size=5), st.text("abc", max_size=10), st.integers(0, 3))
def test_closest_order_against_all_orders(words, entry, most):
    least = min(distance("".join(o), entry) for o in permutations(words))
    assert closest_order(words, entry, most) == (least if least <= most else None)


def test_many_words_are_matched_like_few(monkeypatch):
    m = matcher([("noise cancelling over ear headphones", "headphones"), ("quick start guide", "manual")])
    for v in ("headphones over ear noise cancelling", "ear over headphones cancelling nosie", "over noise ear headphone cancelling", "the headphones of cancelling over ear noise"):
        assert m.closest(v)[3] == "headphones", v
    assert m.closest("headphones over nose chancel rings") is None and m.closest("word " * 50_000) is None
    rng = random.Random(8)
    entries = [(" ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))), f"n{i}") for i in range(60)]
    typed = [" ".join(rng.sample(o.split(), len(o.split()))) for o, _ in entries]
    typed += [t[:-1] + rng.choice("abcd") for t in typed]
    few = [matcher(entries).closest(t) for t in typed]
    monkeypatch.setattr(module, "MAX_ORDERED", 0)
    assert few == [matcher(entries).closest(t) for t in typed] and sum(f is not None for f in few) > 60


def test_fillers_that_an_entry_needs():
    m = matcher([("good quality", "praise"), ("quality", "quality"), ("in total", "sum")])
    assert [m.closest(v)[3] for v in ("very good quality", "Quality good!", "the quality", "total in", "bad quality")] == ["praise", "praise", "quality", "sum", "quality"]


def test_forms_of_an_entry():
    m = matcher([("wear resistance", "durability"), ("fit", "fit"), ("shade of paint", "color"), ("color", "color")])
    for v in (" Wear  Resistance ", "wear_resistance", "resistance of wear", "wearresistance", "WEAR ERSISTANCE!!", "'wear resistance'", "poor wear résistance (general)", "wear resistances of the unit"):
        assert m.closest(v)[3] == "durability", v
    for v in ("colonel", "parking fee", "👍", "", "   ", "the", "42", "fat cat"):
        assert m.closest(v) is None, v
    assert m.closest("paint of shade")[3] == "color"


def test_shards_agree_with_one_tree(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(4, 9))) for _ in range(300)})
    words += ["good quality of abc", "quality", "one two three four five"]
    entries = spark.createDataFrame([(w, w.upper()) for w in words], "original string, normalized string")
    typed = sorted({w[:-1] + rng.choice("abcdefgh") for w in words[::3]} | {"zzzzzz", "", "very good quality of abc", "five four three two oen", "bad quality"})
    monkeypatch.setattr(module, "SHARD_ENTRIES", 20)
    monkeypatch.setattr(module, "PART_VALUES", 15)
    values = spark.createDataFrame([(t,) for t in typed], "value string")
    whole = {tuple(r) for r in map_to_entries(values, entries).collect()}
    assert whole == {tuple(r) for r in map_to_entries(values, entries, broadcast_entries=10).collect()}
    assert len(whole) == len(typed)


def test_unusable_entries_and_no_entries(spark):
    raw = spark.createDataFrame([(" Odor ", "SMELL "), ("odor", "smell"), ("", "x"), ("y", None), (None, "z"), ("w", " ")], "original string, normalized string")
    entries = reference_entries(raw)
    assert [tuple(r) for r in entries.collect()] == [("odor", "smell")]
    values = spark.createDataFrame([("odour",)], "value string")
    assert map_to_entries(values, entries).collect()[0]["normalized"] == "smell"
    assert map_to_entries(values, entries.limit(0)).collect()[0]["normalized"] == "UNMATCHED"
