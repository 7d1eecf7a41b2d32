"""Similarity clusters of short texts by grid density clustering in subspaces.

Every word of a group is one axis of the feature space, quantised into two intervals: the word is absent or present. The
grid is laid, as in the published subspace method CLIQUE, over every three axes, since the full grid of a thousand axes
would hold one text per cell: the cell of three words holds all texts with these words. A cell is dense if two different texts
lie in it, two dense cells are adjacent if they share a text, and clusters are the connected sets of dense cells. Two texts
with three words in common are thus in one cluster, and so are texts that others link; texts in no dense cell stay alone.
Axes that are dense for one text only span no dense cell and are dropped before cells are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.graph import connected_components
from reviewloom.sources.tables import materialize, scratch

#: Words that span a cell.
CELL_WORDS = 3
#: Texts with more frequent words than this get their cells level by level, from dense pairs only.
DIRECT_WORDS = 14


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != ""))


def _cell(*axes: Column) -> Column:
    """128 bits that name the cell of some axes, from the two hashes of each: counting and joining move no text."""
    return F.struct(F.xxhash64(*[w["w1"] for w in axes]).alias("c1"), F.xxhash64(*[w["w2"] for w in axes]).alias("c2"))


def _triples(axes: Column) -> Column:
    """The cells of all combinations of three of the sorted axes."""
    size = F.size(axes)

    def second(i: Column, a: Column) -> Column:
        later = F.slice(axes, i + 2, size)
        return F.flatten(F.transform(later, lambda b, j: F.transform(F.slice(later, j + 2, size), lambda c: _cell(a, b, c))))

    return F.flatten(F.transform(axes, lambda a, i: second(i, a)))


def _axes(values: DataFrame, keys: list[str]) -> DataFrame:
    """(id, words): each value with those of its axes that another value of the group holds too, sorted.

    An axis is named by 128 bits of two hashes of its group and word.
    """
    name = lambda w: F.struct(*[F.xxhash64(F.lit(i), *[F.col(k) for k in keys], w).alias(f"w{i}") for i in (1, 2)])
    held = values.select("id", F.explode(F.transform(words(F.col("value")), name)).alias("w")).select("id", "w.w1", "w.w2")
    frequent = held.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return held.join(frequent, ["w1", "w2"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("w1", "w2"))).alias("words"))


def _long_cells(long: DataFrame, frequent: DataFrame) -> DataFrame:
    """Cells of sets of many axes, built from pairs of axes that are dense themselves."""

    def pairs(df: DataFrame) -> DataFrame:
        a = df.select("id", "n", F.posexplode("words").alias("i", "a"), "words")
        return a.select("id", "n", "a", F.explode(F.slice("words", F.col("i") + 2, F.size("words"))).alias("b"))

    own = pairs(long)
    wanted = own.select("a", "b").distinct()
    dense = pairs(frequent).join(wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.sum("n").alias("m")).where("m > 1").drop("m")
    kept = own.join(dense, ["a", "b"])
    right = kept.select("id", "a", F.col("b").alias("c"))
    third = kept.select("id", F.col("a").alias("b"), F.col("b").alias("c"))
    triples = kept.join(right, ["id", "a"]).where("c > b").join(third, ["id", "b", "c"], "left_semi")
    return triples.select("id", "n", _cell(F.col("a"), F.col("b"), F.col("c")).alias("cell"))


def dense_cells(values: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sets, located) of distinct values with ids.

    sets: id, set_id: values of the same axes lie in the same cells, and are located as one, called by the smallest id.
    located: set_id, c1, c2, n_values, hub: every dense cell of a set, its number of values and its first set.
    """
    own = materialize(_axes(values, keys).where(F.size("words") >= CELL_WORDS))
    name = [F.xxhash64(F.lit(i), "words").alias(f"s{i}") for i in (1, 2)]
    frequent = materialize(own.groupBy("words").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    sets = own.select("id", *name).join(frequent.select(F.col("id").alias("set_id"), *name), ["s1", "s2"]).select("id", "set_id")
    short, long = frequent.where(F.size("words") <= DIRECT_WORDS), frequent.where(F.size("words") > DIRECT_WORDS)
    members = short.select("id", "n", F.explode(_triples(F.col("words"))).alias("cell"))
    if not long.isEmpty():
        members = members.unionByName(_long_cells(long, frequent))
    members = members.select(F.col("id").alias("set_id"), "n", "cell.c1", "cell.c2")
    cells = members.groupBy("c1", "c2").agg(F.sum("n").alias("n_values"), F.min("set_id").alias("hub")).where("n_values > 1")
    return sets, members.drop("n").join(cells, ["c1", "c2"])


def _numbered(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, list[str]]:
    """Distinct values of each group with ids, and the names of the group columns. The ids are fixed by being written."""
    names = [f"k{i}" for i in range(len(keys))]
    group = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(n) for k, n in zip(keys, names, strict=True)]
    distinct = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("value")).distinct()
    return materialize(distinct.withColumn("id", F.monotonically_increasing_id())), names


def _labels(sets: DataFrame, located: DataFrame) -> DataFrame:
    """(id, label) of every id that lies in a dense cell; ids of one cluster have one label."""
    links = materialize(located.groupBy("set_id").agg(F.min("hub").alias("least"), F.collect_set("hub").alias("hubs")))
    edges = links.select(F.explode("hubs").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()
    parts = connected_components(edges).select(F.col("node").alias("least"), "component")
    labels = links.select("set_id", "least").join(parts, "least", "left").select("set_id", F.coalesce("component", "least").alias("label"))
    return sets.join(labels, "set_id").select("id", "label")


def density_clusters(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, first_value) of every distinct value that lies in a cluster; first_value is the cluster's smallest.

    NULL or blank values and values of fewer than three different words stay alone and are not returned; NULL keys form
    groups of their own; repeated rows count once. A cell that holds a third of all values is counted by partial sums and
    represented by its first member, so no task gathers its members; the loop runs over cells' first members only.
    """
    values, names = _numbered(df, keys, value)
    with scratch() as keep:
        labels = keep(materialize(_labels(*dense_cells(values, names))))
    held = values.join(labels, "id")
    firsts = held.groupBy("label").agg(F.min("value").alias("first_value"))
    back = [F.when(F.col(n) != "\0", F.col(n)).alias(k) for k, n in zip(keys, names, strict=True)]
    return held.join(firsts, "label").select(*back, "value", "first_value")


def typical_members(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group and member of its densest cell: keys, first_value, n_values, n_rows, rank, typical and its typical_rows.

    Ranks go by the rows of a member, then by its text. The densest cell holds the most values; of equal ones, that whose
    best member is the most frequent. A value in no dense cell is a group of size 1 and its own member. Every member of a
    cell comes out, so ranks are counted per group in sorted partitions.
    """
    values, names = _numbered(df, keys, value)
    with scratch() as keep:
        sets, located = (keep(materialize(df)) for df in dense_cells(values, names))
        labels = keep(materialize(_labels(sets, located)))
    rows = df.where(F.col(value).isNotNull()).groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("value_rows"))
    held = materialize(values.join(labels, "id", "left").withColumn("alone", F.col("label").isNull()).withColumn("label", F.coalesce("label", "id")).join(rows, [*names, "value"]))
    sizes = held.groupBy("label", "alone", *names).agg(F.count(F.lit(1)).alias("n_values"), F.sum("value_rows").alias("n_rows"), F.min("value").alias("first_value"))
    inside = materialize(located.drop("hub").join(held.join(sets, "id").select("set_id", "label", "value", "value_rows"), "set_id"))
    rated = inside.groupBy("label", "c1", "c2", "n_values").agg(F.max(F.struct("value_rows", "value")).alias("best"))
    densest = rated.groupBy("label").agg(F.max(F.struct("n_values", F.col("best"), "c1", "c2")).alias("d")).select("label", "d.c1", "d.c2")
    chosen = inside.join(densest, ["label", "c1", "c2"]).select("label", F.lit(False).alias("alone"), "value", "value_rows")
    chosen = chosen.unionByName(held.where("alone").select("label", "alone", "value", "value_rows"))
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("label", "alone").orderBy(F.desc("value_rows"), "value")))
    back = [F.when(F.col(n) != "\0", F.col(n)).alias(k) for k, n in zip(keys, names, strict=True)]
    return sizes.join(ranked, ["label", "alone"]).select(*back, "first_value", "n_values", "n_rows", "rank", F.col("value").alias("typical"), F.col("value_rows").alias("typical_rows"))
