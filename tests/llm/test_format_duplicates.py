import collections
import random
import re
import unicodedata

import reviewloom.llm.format_duplicates as module
from reviewloom.llm.format_duplicates import copy_counts, format_duplicates


def norm(t):
    out = []
    for i, c in enumerate(low := t.lower()):
        kind = unicodedata.category(c)[0]
        digit = lambda j: 0 <= j < len(low) and unicodedata.category(low[j])[0] == "N"
        if kind in "LN" or c in ".," and digit(i - 1) and digit(i + 1):
            out.append(c)
    return "".join(out)


def key(t):
    ps = [p for p in re.split("[;|]", t) if p.strip()]
    if len(ps) > 1 and all(re.search("[:：]", p) for p in ps):
        return "parts", tuple(sorted(norm(p) for p in ps))
    return "text", norm(t)


def brute(rows):
    groups = collections.defaultdict(set)
    for run, i, t in rows:
        if i is not None and t is not None:
            groups[run, key(t)].add(i)
    return {(run, min(ids), i) for (run, _), ids in groups.items() for i in ids if i != min(ids)}


BASES = ["Costs 2.5 or 25", "costs 25, or 25", "Costs 2,5 or 25", "A: x; B: 1.2", "B: 1.2 | a: X", "A: x; A: x; B: 1.2", "A: x B: 1.2", "a; b", "b; a", "", "...", "Größe! 3", "GRÖSSE 3", "नमस्ते दुनिया", "x" * 20_000]


def rows_of(n):
    rng = random.Random(1)
    out = []
    for i in range(n):
        t = rng.choice(BASES)
        t = rng.choice([str.upper, str.lower, str.title, lambda s: s.replace(" ", "  "), lambda s: s + "!", lambda s: s])(t)
        out.append((rng.choice(["r1", "r2", None]), f"s{rng.randrange(n)}", t))
    return [*out, ("r1", None, "a"), ("r1", "z", None), ("r1", "z2", "only here")]


def test_against_brute_force(spark):
    rows = rows_of(400)
    df = spark.createDataFrame(rows, "run string, id string, t string").withColumnRenamed("t", "scope")
    got = {tuple(r) for r in format_duplicates(df, "run", "id", "scope").collect()}
    assert got == brute(rows)


def test_hot_groups_are_spread(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT_ROWS", 20)
    rows = rows_of(400)
    df = spark.createDataFrame(rows, "run string, id string, t string")
    assert {tuple(r) for r in format_duplicates(df, "run", "id", "t").collect()} == brute(rows)


def test_copies_and_empty_table(spark):
    df = spark.createDataFrame([("r", "b", "Hi there"), ("r", "a", "hi, there!"), ("r", "a", "hi, there!"), ("q", "c", "hi there")], "run string, id string, t string")
    assert {tuple(r) for r in copy_counts(df, "run", "id", "t").collect()} == {("r", "a", 2), ("q", "c", 1)}
    assert format_duplicates(df.limit(0), "run", "id", "t").count() == 0


def test_records_of_one_fingerprint_are_told_apart_by_their_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "_sum_of_hashes", lambda pieces, seed: module.F.lit(0).cast("long"))
    rows = rows_of(300)
    df = spark.createDataFrame(rows, "run string, id string, t string")
    assert {tuple(r) for r in format_duplicates(df, "run", "id", "t").collect()} == brute(rows)
    want = collections.defaultdict(set)
    for run, i, t in rows:
        if i is not None and t is not None:
            want[run, key(t)].add(i)
    assert collections.Counter(map(tuple, copy_counts(df, "run", "id", "t").collect())) == collections.Counter((run, min(ids), len(ids)) for (run, _), ids in want.items())
