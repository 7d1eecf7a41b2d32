"""Similarity graphs over clustered records: best edges, reconciliation of labels by components, and DBSCAN."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.graph import connected_components
from reviewloom.operators.ordering import dense_ranks
from reviewloom.operators.providers import Reranker, rerank, reranked
from reviewloom.operators.vectors import near_pairs, nearest
from reviewloom.sources.tables import materialize, scratch

#: Rows of a tile side; a tile is the unit of work of the distance join.
TILE_ROWS = 2000
#: Bytes of vectors up to which every worker holds all rows whose pairs are reranked.
HELD_BYTES = 256 * 1024 * 1024


def best_edges(rows: DataFrame, targets: DataFrame, key: str, vector: str, least: float, most: int = 10, candidates: int = 50, bucket: str | None = None) -> DataFrame:
    """(src, dst, score): undirected edges between rows and their nearest targets, the best per pair, no loops.

    With `bucket`, the candidates are the nearest of all targets, those of other buckets are left out, and each row keeps
    the `most` best of the rest; NULL is a bucket of its own.
    """
    near = nearest(rows, targets, key, vector, most=max(most, candidates)).where(F.col("score") >= least)
    if bucket is not None:
        own = rows.select(F.col(key).alias("k"), F.col(bucket).alias("bucket"))
        other = targets.select(F.col(key).alias("target"), F.col(bucket).alias("other"))
        near = near.join(own, "k").join(other, "target").where(F.col("bucket").eqNullSafe(F.col("other")))
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("rank")))
    near = near.where(F.col("rank") <= most)
    pairs = near.select(F.least("k", "target").alias("src"), F.greatest("k", "target").alias("dst"), "score")
    return pairs.groupBy("src", "dst").agg(F.max("score").alias("score"))


def reranked_edges(rows: DataFrame, key: str, vector: str, text: str, bucket: str, build: Callable[[], Reranker], least: float = 0.6, most: int = 10, candidates: int = 50, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(src, dst, score): undirected edges inside a bucket whose texts a reranker finds alike, the best per pair, no loops.

    Each row's nearest rows by vector are its candidates; those of its bucket are scored, and it keeps the `most` best of them
    from `least` on. NULL is a bucket of its own. Texts are scored where the pairs are: up to `held_bytes` of vectors, a row's pairs
    are found, scored and chosen in one task; beyond, they are merged from tiles.
    """
    with scratch() as keep:
        own = materialize(rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(bucket).cast("string").alias("bucket"), F.col(text).alias("text")))
        return keep(materialize(_reranked_edges(own, build, least, most, candidates, held_bytes)))


def _chosen(build: Callable[[], Reranker], least: float, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in reranked(frames, "text", "other_text", build):
            frame = frame[frame["rerank_score"] >= least]
            frame = frame.iloc[np.lexsort((frame["place"], -frame["rerank_score"], frame["i"]))]
            yield frame.groupby("i").head(most)[["k", "target", "rerank_score"]]

    return run


def _reranked_edges(own: DataFrame, build: Callable[[], Reranker], least: float, most: int, candidates: int, held_bytes: int) -> DataFrame:
    kind = own.schema["k"].dataType.simpleString()
    if (own.agg(F.sum(F.size("v"))).first()[0] or 0) * 8 <= held_bytes:
        scored = near_pairs(own, candidates, _chosen(build, least, most), f"k {kind}, target {kind}, rerank_score double")
    else:
        near = nearest(own, own, "k", "v", most=candidates).select("k", "target")
        other = own.select(F.col("k").alias("target"), F.col("bucket").alias("other"), F.col("text").alias("other_text"))
        pairs = near.join(own, "k").join(other, "target").where(F.col("bucket").eqNullSafe(F.col("other"))).select("k", "target", "text", "other_text")
        scored = rerank(pairs, "text", "other_text", build).where(F.col("rerank_score") >= least)
    order = Window.partitionBy("k").orderBy(F.desc("rerank_score"), "target")
    kept = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return kept.groupBy(F.least("k", "target").alias("src"), F.greatest("k", "target").alias("dst")).agg(F.max("rerank_score").alias("score"))


def reconcile_labels(labels: DataFrame, edges: DataFrame, key: str, label: str, noise: int = -1) -> DataFrame:
    """(key, new_label): per component without any label all stay noise, otherwise all take its smallest label."""
    parts = connected_components(edges.select("src", "dst")).withColumnsRenamed({"node": key, "component": "part"})
    rows = labels.join(parts, key, "left").withColumn("part", F.coalesce("part", key))
    least = rows.where(F.col(label) != noise).groupBy("part").agg(F.min(label).alias("least"))
    return rows.join(least, "part", "left").select(key, F.coalesce("least", F.lit(noise)).alias("new_label"))


def _close(left: pd.Series, right: pd.Series, eps: float) -> np.ndarray:
    a, b = (np.asarray(v.tolist(), dtype=np.float64) for v in (left, right))
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T <= eps * eps + 1e-12


def _neighbour_counts(eps: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = _close(left["v"], right["v2"], eps).sum(1) if len(left) and len(right) else np.zeros(len(left), dtype=np.int64)
        return pd.DataFrame({"k": left["k"], "n": n})

    return run


def _tile_links(eps: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a pair of tiles adds to the graph of core rows: each core row with the smallest of its component, and each other
    row with its smallest core neighbour. That is at most one link per row, however many pairs are close."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right[right["core2"]].sort_values("k2", kind="stable")
        if left.empty or right.empty:
            return pd.DataFrame({"src": left["k"].iloc[:0], "dst": right["k2"].iloc[:0], "among": pd.Series(dtype="bool")})
        near = _close(left["v"], right["v2"], eps)
        core, first = left["core"].to_numpy(dtype=bool), near.argmax(1)
        label, rows = np.arange(len(right)), near[core]
        moving = rows.any()
        while moving:  # minimum labels over the bipartite graph of this pair
            of_row = np.where(rows, label[None, :], len(right)).min(1)
            of_column = np.minimum(label, np.where(rows, of_row[:, None], len(right)).min(0))
            moving = (of_column != label).any()
            label = of_column
        ids, own = right["k2"].to_numpy(), left["k"].to_numpy()
        linked = rows.any(1) if core.any() else np.zeros(0, dtype=bool)
        heads = np.where(rows, label[None, :], len(right)).min(1)[linked] if core.any() else np.zeros(0, dtype=np.int64)
        beside = ~core & near.any(1)
        moved = np.flatnonzero(label != np.arange(len(right)))
        parts = [(own[core][linked], ids[heads], True), (ids[moved], ids[label[moved]], True), (own[beside], ids[first[beside]], False)]
        return pd.concat([pd.DataFrame({"src": a, "dst": b, "among": c}) for a, b, c in parts], ignore_index=True)

    return run


def _tiles(df: DataFrame, key: str, vector: str, eps: float, scope: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): rows (k, v, scope, slab, tile) and the pairs of tiles that can hold rows within eps.

    Rows within eps differ by at most eps in any coordinate, so a row meets only its own slab of width eps along the
    first coordinate and the two beside it. Slabs are cut into tiles of bounded size; a pair of tiles is one matrix product.
    """
    within = F.lit("") if scope is None else F.coalesce(F.col(scope).cast("string"), F.lit(""))
    slab = F.floor(F.col(vector)[0].cast("double") / eps).cast("long")
    rows = materialize(df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), within.alias("scope"), slab.alias("slab")))
    sizes = materialize(rows.groupBy("scope", "slab").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("tiles")))
    tiled = rows.join(sizes, ["scope", "slab"]).withColumn("tile", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int")).drop("tiles")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    near = sizes.withColumn("other", F.explode(F.array(F.col("slab") - 1, F.col("slab"), F.col("slab") + 1)))
    near = near.join(sizes.select("scope", F.col("slab").alias("other"), F.col("tiles").alias("other_tiles")), ["scope", "other"])
    pairs = near.withColumn("tile", every("tiles")).withColumn("other_tile", every("other_tiles")).select("scope", "slab", "tile", "other", "other_tile")
    return tiled, pairs


def _paired(rows: DataFrame, pairs: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`run` over every pair of tiles; columns of the second tile are called k2, v2 and so on."""
    on = ["scope", "slab", "tile", "other", "other_tile"]
    own = [c for c in rows.columns if c not in ("scope", "slab", "tile")]
    left = rows.join(pairs, ["scope", "slab", "tile"]).select(*on, *own)
    right = rows.withColumnsRenamed({"slab": "other", "tile": "other_tile"}).join(pairs, ["scope", "other", "other_tile"])
    right = right.select(*[F.col(c).alias(f"{c}_2") for c in on], *[F.col(c).alias(f"{c}2") for c in own])
    return left.groupBy(*on).cogroup(right.groupBy(*[f"{c}_2" for c in on])).applyInPandas(run, schema)


def dbscan(df: DataFrame, key: str, vector: str, eps: float = 0.5, min_samples: int = 5, scope: str | None = None) -> DataFrame:
    """(key, cluster): cluster is the smallest core key of the cluster, NULL for noise.

    Core rows have at least `min_samples` rows within eps, themselves included; a row beside several clusters joins that
    of its smallest core neighbour. Keys must be unique; rows without a vector are noise. Neighbours are counted first and
    pairs are never written: every pair of tiles gives at most one link per row.
    """
    with scratch() as keep:
        found = keep(materialize(_dbscan_labels(df, key, vector, eps, min_samples, scope)))
    return df.select(key).join(found, key, "left")


def _dbscan_labels(df: DataFrame, key: str, vector: str, eps: float, min_samples: int, scope: str | None) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    rows, pairs = _tiles(df, key, vector, eps, scope)
    counts = _paired(rows, pairs, _neighbour_counts(eps), f"k {kind}, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    marked = materialize(rows.join(counts, "k").withColumn("core", F.col("n") >= min_samples).drop("n"))
    links = materialize(_paired(marked, pairs, _tile_links(eps), f"src {kind}, dst {kind}, among boolean"))
    parts = connected_components(links.where("among").select("src", "dst"))
    core = marked.where("core").select(F.col("k").alias("core"))
    named = core.join(parts.withColumnRenamed("node", "core"), "core", "left").select("core", F.coalesce("component", "core").alias("cluster"))
    beside = links.where("not among").groupBy("src").agg(F.min("dst").alias("core"))
    border = beside.join(named, "core").select(F.col("src").alias(key), "cluster")
    return named.withColumnRenamed("core", key).select(key, "cluster").unionByName(border)


def offset_labels(df: DataFrame, bucket: str, label: str, noise: int = -1) -> DataFrame:
    """Labels that are unique over all buckets: ranks of (bucket, label) from 0; noise keeps its mark."""
    pairs = df.where(F.col(label) != noise).select(bucket, label).distinct()
    ranked = dense_ranks(pairs, [bucket, label], "global_label").withColumn("global_label", F.col("global_label").cast("int"))
    return df.join(ranked, [bucket, label], "left").withColumn("global_label", F.coalesce("global_label", F.lit(noise)))
