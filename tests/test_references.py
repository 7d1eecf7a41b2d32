from datetime import datetime

from reviewloom.operators.references import clean_id, orphan_references, orphans_by_period


def day(d, month=1):
    return datetime(2024, month, d)


def test_missing_late_and_found(spark):
    parents = spark.createDataFrame([("r1", "a", day(1)), ("r1", "a", day(9)), ("r1", "late", day(5)), ("r2", "b", day(1)), ("r1", None, day(1)), (None, "x", day(1)), ("r1", "undated", None)], "scope string, id string, created_at timestamp")
    refs = [
        ("t", "r1", "a", "k", day(2)),
        ("t", "r1", "late", "k", day(2)),
        ("t", "r1", "late", "k", day(2)),
        ("t", "r1", "late", "k", day(6, 2)),
        ("t", "r1", "b", "k", day(2)),
        ("u", "r2", "gone", None, day(3, 3)),
        ("u", "r2", None, "k", day(3)),
        ("u", None, "gone", "k", day(3)),
        ("u", "r1", "undated", "k", day(3)),
        ("u", "r1", "late", "n", None),
    ]
    children = spark.createDataFrame(refs, "ref_table string, scope string, id string, ref_key string, created_at timestamp")
    got = orphan_references(parents, children)
    assert {tuple(r) for r in got.collect()} == {("t", "2024-01", "r1", "k", "late", "late"), ("t", "2024-01", "r1", "k", "b", "missing"), ("u", "2024-03", "r2", None, "gone", "missing")}
    assert {tuple(r) for r in orphans_by_period(got).collect()} == {("t", "2024-01", "late", 1, 1), ("t", "2024-01", "missing", 1, 1), ("u", "2024-03", "missing", 1, 1)}
    assert orphan_references(parents.limit(0), children.limit(0)).count() == 0


def test_ids_are_cleaned(spark):
    df = spark.createDataFrame([(" Ab ",), ("\t",), ("",), (None,)], "i string")
    assert [r[0] for r in df.select(clean_id("i")).collect()] == ["ab", None, None, None]
