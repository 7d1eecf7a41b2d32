import random

import reviewloom.llm.density as module
from reviewloom.llm.density import density_clusters, typical_members


def brute(rows):
    values = {(a, b, v) for a, b, v in rows if v is not None}
    label = {x: x[2] for x in values}
    moved = True
    while moved:
        moved = False
        for x in values:
            for y in values:
                if x[:2] == y[:2] and len(set(x[2].split()) & set(y[2].split())) >= 3 and label[y] < label[x]:
                    label[x], moved = label[y], True
    linked = {x for x in values for y in values if x != y and x[:2] == y[:2] and len(set(x[2].split()) & set(y[2].split())) >= 3}
    return {(*x, label[x]) for x in linked}


def rows_of(n, words=14, most=7):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(words)]
    out = [(rng.choice(["r", None]), rng.choice("ab"), " ".join(rng.choices(vocabulary, k=rng.randint(1, most)))) for _ in range(n)]
    return [*out, *out[:5], ("r", "a", None), ("r", "a", ""), ("r", "a", "  ")]


def test_against_brute_force(spark):
    rows = rows_of(120)
    df = spark.createDataFrame(rows, "cell string, hub string, v string")
    assert {tuple(r) for r in density_clusters(df, ["cell", "hub"], "v").collect()} == brute(rows)


def test_long_values_give_the_same_cells(spark, monkeypatch):
    monkeypatch.setattr(module, "DIRECT_WORDS", 4)
    rows = rows_of(60, words=40, most=12)
    df = spark.createDataFrame(rows, "run string, aspect string, v string")
    assert {tuple(r) for r in density_clusters(df, ["run", "aspect"], "v").collect()} == brute(rows)


def test_very_long_value_and_empty_table(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    df = spark.createDataFrame([("r", "a", long), ("r", "a", "x1 x2 x3"), ("r", "a", "x9 y z")], "run string, aspect string, v string")
    assert {tuple(r) for r in density_clusters(df, ["run", "aspect"], "v").select("value", "first_value").collect()} == {(long, long), ("x1 x2 x3", long)}
    assert density_clusters(df.limit(0), ["run", "aspect"], "v").count() == 0


def test_typical_members_are_all_of_the_densest_cell(spark):
    df = spark.createDataFrame([("r", "a b c d"), ("r", "a b c d"), ("r", "a b c"), ("r", "c d e b"), ("r", "a b c z"), ("r", "q w z"), (None, "q w z"), ("r", None)], "run string, v string")
    want = {("r", "a b c", 4, 5, i + 1, v, n) for i, (v, n) in enumerate([("a b c d", 2), ("a b c", 1), ("a b c z", 1)])}
    assert {tuple(r) for r in typical_members(df, ["run"], "v").collect()} == want | {("r", "q w z", 1, 1, 1, "q w z", 1), (None, "q w z", 1, 1, 1, "q w z", 1)}
    assert typical_members(df.limit(0), ["run"], "v").count() == 0
