"""Per-key work that stays even when a few keys hold most rows: fragment-replicate by estimated load.

Loads are estimated by one sketch of frequent items, which every task fills from its own rows and which merges to a bounded
size; no key is shuffled for it. Keys above the target load of a task are split into shards in proportion to their load; all
other keys are folded into a fixed number of hash buckets. For a join, buckets and shards are packed onto tasks by decreasing
load, rows are sent straight to their task, and the matching side is copied only to the shards of split keys. Aggregates are
summed inside each input partition first, so that only partial results of shards move. Estimates steer the balance alone;
results do not depend on them.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets into which the keys below the target load are folded.
BUCKETS = 4096
#: Items per task that the sketch of frequent keys tracks.
TRACKED_PER_TASK = 40


@dataclass
class Placement:
    """Where the rows of each key go: buckets of light keys, shards of heavy ones, each with its task."""

    tasks: int
    target: int
    heavy: list[tuple[object, int, int]]  # key, rows, shards
    table: list[tuple[int, int, int]]  # unit, shard, task; units below BUCKETS are buckets, above are heavy keys
    loads: list[float]  # by task, estimated


def pack(units: list[tuple[int, int, float]], tasks: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Longest-processing-time packing of (unit, shard, load) onto tasks: the next largest goes to the least loaded task."""
    heap = [(0, t) for t in range(tasks)]
    placed, loads = [], [0] * tasks
    for unit, shard, load in sorted(units, key=lambda u: (-u[2], u[0], u[1])):
        total, task = heapq.heappop(heap)
        placed.append((unit, shard, task))
        loads[task] = total + load
        heapq.heappush(heap, (total + load, task))
    return placed, loads


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def plan_placement(df: DataFrame, key: str, tasks: int) -> Placement:
    """Placement of the keys of `df` on `tasks` tasks. An empty table gives a placement without load; NULL keys have none.

    The sketch tracks TRACKED_PER_TASK items per task, so that its error stays far below the load of one. Light keys count as
    spread evenly over the buckets.
    """
    most = 2 * tasks  # no more keys can hold half of the target each
    tracked = min(1_000_000, max(10_000, TRACKED_PER_TASK * tasks))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {most}, {tracked})").alias("top")).first()
    total = found["n"]
    target = max(1, -(-total // tasks))
    heavy = [(r["item"], r["count"], -(-2 * r["count"] // target)) for r in found["top"] if r["count"] > target / 2]
    heavy.sort(key=lambda h: (-h[1], str(h[0])))
    light = max(0, total - sum(n for _, n, _ in heavy)) / BUCKETS
    units = [(b, 0, light) for b in range(BUCKETS)]
    units += [(BUCKETS + i, s, n // shards) for i, (_, n, shards) in enumerate(heavy) for s in range(shards)]
    placed, by_task = pack(units, tasks)
    return Placement(tasks, target, heavy, placed, by_task)


def _units(df: DataFrame, key: str, placement: Placement) -> DataFrame:
    """Adds fr_unit and fr_shards to every row."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = [(k, BUCKETS + i, shards) for i, (k, _, shards) in enumerate(placement.heavy)]
    heavy = spark.createDataFrame(rows, f"fr_key {kind}, fr_heavy int, fr_split int")
    joined = df.join(F.broadcast(heavy), F.col(key) == F.col("fr_key"), "left")
    return joined.withColumn("fr_unit", F.coalesce("fr_heavy", _bucket(F.col(key)))).withColumn("fr_shards", F.coalesce("fr_split", F.lit(1))).drop("fr_key", "fr_heavy", "fr_split")


def _to_tasks(df: DataFrame, placement: Placement) -> DataFrame:
    table = df.sparkSession.createDataFrame(placement.table, "fr_unit int, fr_shard int, fr_task int")
    return df.join(F.broadcast(table), ["fr_unit", "fr_shard"]).repartitionById(placement.tasks, F.col("fr_task"))


def fragment(df: DataFrame, key: str, placement: Placement) -> DataFrame:
    """Rows spread over their tasks (fr_task, fr_shard); the rows of a split key take its shards in turn. NULL keys drop."""
    rows = _units(df.where(F.col(key).isNotNull()), key, placement)
    shard = F.pmod(F.monotonically_increasing_id(), F.col("fr_shards")).cast("int")
    return _to_tasks(rows.withColumn("fr_shard", shard), placement).drop("fr_unit", "fr_shards")


def replicate(df: DataFrame, key: str, placement: Placement) -> DataFrame:
    """The matching side: one copy per row, and for split keys one copy per shard."""
    rows = _units(df.where(F.col(key).isNotNull()), key, placement)
    copies = F.explode(F.sequence(F.lit(0), F.col("fr_shards") - 1))
    return _to_tasks(rows.withColumn("fr_shard", copies), placement).drop("fr_unit", "fr_shards")


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, tasks: int | None = None, how: str = "inner", placement: Placement | None = None) -> DataFrame:
    """Equi-join in which the rows of a heavy key of `left` are spread over several tasks.

    how: inner or left. NULL keys match nothing: they drop from an inner join, and a left join keeps them with NULLs.
    Repeated rows and several matches multiply as in any join. Other columns of the two sides must differ in name.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    placement = placement or plan_placement(left, key, tasks or default_tasks(left))
    joined = fragment(left, key, placement).join(replicate(right, key, placement), ["fr_task", "fr_shard", key], how)
    joined = joined.drop("fr_task", "fr_shard")
    if how == "left":
        rest = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key])
        joined = joined.select(*rest.columns).unionByName(rest)
    return joined


def default_tasks(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def balanced_group_agg(df: DataFrame, key: str, partial: list[Column], final: list[Column], placement: Placement | None = None) -> DataFrame:
    """Per-key results in two steps: per shard of a key, then over the few shards of each key.

    partial: aggregates of the first step, aliased, that Spark can begin before a shuffle; final: aggregates over those
    aliases. NULL keys form no group. The shards of a heavy key are its input partitions modulo their number, so that each
    task sends one partial row per key, and a key that fills all partitions is added up in several tasks.
    """
    placement = placement or plan_placement(df, key, default_tasks(df))
    rows = _units(df.where(F.col(key).isNotNull()), key, placement)
    shards = rows.withColumn("fr_shard", F.pmod(F.spark_partition_id(), F.col("fr_shards"))).groupBy("fr_shard", key).agg(*partial)
    return shards.groupBy(key).agg(*final)
