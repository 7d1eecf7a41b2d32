import pytest
from pyspark.sql import functions as F

from reviewloom.operators.skew import balanced_group_agg, fragment, fragment_replicate_join, pack, plan_placement


@pytest.fixture
def hot(spark):
    """One key with a third of all rows, some middling ones, many light ones, and NULLs."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("m"), F.col("id") % 5)).when(F.col("id") % 97 == 0, None).otherwise(F.concat(F.lit("l"), F.col("id") % 1000))
    return spark.range(9000).select(key.alias("k"), (F.col("id") % 7).cast("double").alias("x"), F.col("id").alias("n"))


def test_packing_is_even():
    placed, loads = pack([(i, 0, 10) for i in range(40)] + [(99, s, 25) for s in range(4)], 4)
    assert len(placed) == 44 and max(loads) - min(loads) <= 25


def test_no_task_holds_a_hot_key_alone(hot):
    placement = plan_placement(hot, "k", 8)
    by_task = [r["n"] for r in fragment(hot, "k", placement).groupBy("fr_task").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(by_task) == hot.where("k is not null").count()
    assert max(by_task) <= 1.6 * placement.target


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain_join(spark, hot, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("m1", 3), ("l5", 4), (None, 5), ("none", 6)], "k string, y int")
    got = sorted(fragment_replicate_join(hot, right, "k", 8, how).collect(), key=str)
    want = sorted(hot.join(right, "k", how).select("k", "x", "n", "y").collect(), key=str)
    assert [tuple(r.asDict()[c] for c in ("k", "x", "n", "y")) for r in got] == [tuple(r) for r in want]


def test_join_refuses_clashing_columns(hot):
    with pytest.raises(ValueError):
        fragment_replicate_join(hot, hot, "k")


def test_two_step_aggregate_equals_plain(hot):
    got = balanced_group_agg(hot, "k", [F.count(F.lit(1)).alias("c"), F.sum("x").alias("s")], [F.sum("c").alias("c"), F.sum("s").alias("s")])
    want = hot.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.sum("x").alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty_and_single_key_tables(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert plan_placement(empty, "k", 4).heavy == [] and plan_placement(empty, "k", 4).target == 1
    assert balanced_group_agg(empty, "k", [F.count("x").alias("c")], [F.sum("c").alias("c")]).count() == 0
    one = spark.range(1000).select(F.lit("a").alias("k"), F.lit(1.0).alias("x"))
    assert balanced_group_agg(one, "k", [F.count("x").alias("c")], [F.sum("c").alias("c")]).collect()[0]["c"] == 1000


def test_aggregates_move_partial_rows_only(hot):
    placement = plan_placement(hot, "k", 8)
    assert placement.heavy[0][0] == "hot" and placement.heavy[0][2] > 1 and abs(placement.heavy[0][1] - 3000) < 100
    plan = balanced_group_agg(hot, "k", [F.sum("x").alias("s")], [F.sum("s").alias("s")], placement)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "partial_sum" in below and "REPARTITION" not in plan


def test_extra_columns_and_other_types(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("k"), F.lit("a").alias("fr_extra"), F.col("id").cast("int").alias("value"))
    got = balanced_group_agg(df, "k", [F.count("value").alias("c")], [F.sum("c").alias("c")])
    assert {tuple(r) for r in got.collect()} == {(0, 200), (1, 200)}
