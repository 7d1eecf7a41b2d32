"""Clustering kernels for buckets, and the choice of a method by bucket size.

A bucket of one row is its own cluster, small ones go to agglomerative clustering, all others to hierarchical density
clustering. Linkage needs all distances of a bucket at once, so it is refused above MAX_KERNEL_ROWS rows. Hierarchical density
clustering computes them row by row there, with the same result: memory grows with the rows, time with their square, in one
task per bucket. DBSCAN, if asked for, is spread over all executors whatever the size of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.neighbor_graph import dbscan

#: Buckets below this go to average linkage.
SMALL = 100
#: Rows of which all distances are held at once, at most.
MAX_KERNEL_ROWS = 5_000
#: A bucket stage is worth its cost from so many rows per bucket.
ROWS_PER_BUCKET = 100.0


def _distances(vectors: np.ndarray, by: str) -> np.ndarray:
    if by == "cosine":
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
        out = 1 - unit @ unit.T
    else:
        squares = (vectors**2).sum(1)
        out = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * vectors @ vectors.T, 0))
    np.fill_diagonal(out, 0)
    return np.maximum(out, 0)


def _renumber(labels: np.ndarray) -> np.ndarray:
    """Labels by first appearance from 0; -1 stays."""
    known: dict[int, int] = {}
    return np.array([-1 if x < 0 else known.setdefault(int(x), len(known)) for x in labels], dtype=np.int64)


def agglomerative(vectors: np.ndarray, threshold: float | None = 0.5, n_clusters: int | None = None, by: str = "cosine", linkage: str = "average") -> np.ndarray:
    """Linkage until the closest clusters are farther apart than the threshold, or n_clusters are left.

    linkage: average, or ward, which measures Euclidean distance whatever `by` asks for. Ties join the clusters that hold
    the earlier rows.
    """
    n = len(vectors)
    if n > MAX_KERNEL_ROWS:
        raise ValueError(f"agglomerative clustering of {n} rows; it needs all distances at once, of at most {MAX_KERNEL_ROWS}")
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    d = _distances(np.asarray(vectors, dtype=np.float64), "euclidean" if linkage == "ward" else by)
    np.fill_diagonal(d, np.inf)
    size, labels, alive = np.ones(n), np.arange(n), n
    while alive > (n_clusters or 1):
        i, j = divmod(int(np.argmin(d)), n)
        if n_clusters is None and d[i, j] > threshold:
            break
        i, j = min(i, j), max(i, j)
        if linkage == "ward":
            joint = size[i] + size[j] + size
            with np.errstate(invalid="ignore"):
                merged = np.sqrt(((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * d[i, j] ** 2) / joint)
            merged[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        else:
            merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        labels[labels == j] = i
        alive -= 1
    return _renumber(labels)


def _reach(vectors: np.ndarray, min_samples: int) -> Callable[[int], np.ndarray]:
    """Mutual reachability of a row to all; above MAX_KERNEL_ROWS rows no matrix of all distances is held.

    Distances are rounded, so that ties are the same in both forms.
    """
    n, k = len(vectors), min(min_samples, len(vectors)) - 1
    if n <= MAX_KERNEL_ROWS:
        d = np.round(_distances(vectors, "euclidean"), 12)
        core = np.sort(d, axis=1)[:, k]
        reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
        return lambda u: reach[u]
    squares = (vectors**2).sum(1)

    def distances(i: int, j: int) -> np.ndarray:
        out = np.sqrt(np.maximum(squares[i:j, None] + squares[None, :] - 2 * vectors[i:j] @ vectors.T, 0))
        out[np.arange(j - i), np.arange(i, j)] = 0
        return np.round(out, 12)

    step = max(1, 4_000_000 // n)
    core = np.concatenate([np.partition(distances(i, min(i + step, n)), k, axis=1)[:, k] for i in range(0, n, step)])
    return lambda u: np.maximum(distances(u, u + 1)[0], np.maximum(core[u], core))


def condensed_tree(vectors: np.ndarray, min_cluster_size: int, min_samples: int) -> list[tuple[int, int, float, int]]:
    """Rows (parent, child, lambda, size) of the density hierarchy; points are 0..n-1, clusters from n on."""
    n = len(vectors)
    reach = _reach(np.asarray(vectors, dtype=np.float64), min_samples)
    inside, best, source = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    best[0], edges = 0, []
    for _ in range(n):
        u = int(np.argmin(np.where(inside, np.inf, best)))
        if inside.any():
            edges.append((best[u], source[u], u))
        inside[u] = True
        near = reach(u)
        closer = ~inside & (near < best)
        best[closer], source[closer] = near[closer], u
    parent, children, height = list(range(n)), {}, {}
    sizes = dict.fromkeys(range(n), 1)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for w, a, b in sorted(edges):
        a, b, node = root(a), root(b), len(parent)
        parent += [node]
        parent[a] = parent[b] = node
        children[node], height[node], sizes[node] = (a, b), w, sizes[a] + sizes[b]

    def leaves(x: int) -> list[int]:
        out, open_nodes = [], [x]
        while open_nodes:
            y = open_nodes.pop()
            if y in children:
                open_nodes += children[y]
            else:
                out.append(y)
        return out

    rows, following = [], n + 1
    open_nodes = [(len(parent) - 1, n)] if n > 1 else []
    while open_nodes:
        node, cluster = open_nodes.pop()
        while node in children:
            a, b = children[node]
            lam = 1 / height[node] if height[node] > 0 else np.inf
            big = [c for c in (a, b) if sizes[c] >= min_cluster_size]
            if len(big) == 2:
                for c in (a, b):
                    rows.append((cluster, following, lam, sizes[c]))
                    open_nodes.append((c, following))
                    following += 1
                break
            for c in (a, b):
                if c not in big:
                    rows += [(cluster, p, lam, 1) for p in leaves(c)]
            if not big:
                break
            node = big[0]
    return rows


def hdbscan(vectors: np.ndarray, min_cluster_size: int | None = None, min_samples: int = 3) -> np.ndarray:
    """Labels by excess of mass over the condensed tree; -1 is noise. The root is never a cluster."""
    n = len(vectors)
    smallest = min_cluster_size or max(10, int(0.005 * n))
    if n < 2 * smallest:
        return np.full(n, -1, dtype=np.int64)
    rows = condensed_tree(vectors, smallest, min_samples)
    finite = max((lam for _, _, lam, _ in rows if np.isfinite(lam)), default=1.0)
    rows = [(p, c, lam if np.isfinite(lam) else finite * 2, s) for p, c, lam, s in rows]
    birth = {c: lam for _, c, lam, s in rows if c > n} | {n: 0.0}
    stability = dict.fromkeys(birth, 0.0)
    below: dict[int, list[int]] = {c: [] for c in birth}
    for p, c, lam, s in rows:
        stability[p] += (lam - birth[p]) * s
        if c > n:
            below[p].append(c)
    chosen = set()
    for c in sorted(birth, reverse=True):
        if c == n:
            continue
        inner = sum(stability[x] for x in below[c])
        if below[c] and inner > stability[c]:
            stability[c] = inner
        else:
            chosen.add(c)
    final: dict[int, int] = {}
    open_nodes = [(c, -1) for c in below[n]]
    while open_nodes:
        c, owner = open_nodes.pop()
        owner = c if owner < 0 and c in chosen else owner
        final[c] = owner
        open_nodes += [(x, owner) for x in below[c]]
    labels = np.full(n, -1, dtype=np.int64)
    for p, c, _, _ in rows:
        if c < n:
            labels[c] = final.get(p, -1)
    return _renumber(labels)


def _bucket_kernel(method: str | None, options: dict, min_cluster_size: int | None, min_samples: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k", kind="stable")
        n = len(frame)
        used = method or ("single" if n < 2 else "agglomerative" if n < SMALL else "hdbscan")
        vectors = np.asarray(frame["v"].tolist(), dtype=np.float64)
        if used == "single":
            labels = np.zeros(n, dtype=np.int64)
        elif used == "agglomerative":
            labels = agglomerative(vectors, **options)
        else:
            labels = hdbscan(vectors, min_cluster_size, min_samples)
        return pd.DataFrame({"k": frame["k"], "bucket": frame["bucket"], "method": used, "label": labels.astype("int32")})

    return run


def _bucketed(df: DataFrame, bucket: str, key: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.coalesce(F.col(bucket).cast("string"), F.lit("")).alias("bucket"))


def cluster_buckets(
    df: DataFrame,
    bucket: str,
    key: str,
    vector: str,
    method: str | None = None,
    threshold: float | None = 0.5,
    min_cluster_size: int | None = None,
    min_samples: int = 3,
    eps: float = 0.5,
    n_clusters: int | None = None,
    linkage: str = "average",
    metric: str = "cosine",
) -> DataFrame:
    """(key, bucket, method, label) of every row: labels count from 0 within a bucket, -1 is noise.

    method: agglomerative, hdbscan or dbscan; without it, a bucket of one row is its own cluster, below SMALL rows linkage
    is used and beyond that hierarchical density clustering, at any size. Linkage of a bucket above MAX_KERNEL_ROWS rows is
    an error. NULL buckets form one bucket; keys must be unique; rows without a vector are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = _bucketed(df, bucket, key, vector)
    if method == "dbscan":
        found = dbscan(rows, "k", "v", eps, min_samples, scope="bucket").join(rows.select("k", "bucket"), "k")
        names = found.where("cluster is not null").select("bucket", "cluster").distinct()
        ranks = names.withColumn("label", (F.dense_rank().over(Window.partitionBy("bucket").orderBy("cluster")) - 1).cast("int"))
        done = found.join(ranks, ["bucket", "cluster"], "left").select("k", "bucket", F.lit("dbscan").alias("method"), F.coalesce("label", F.lit(-1)).alias("label"))
    else:
        options = {"threshold": threshold, "n_clusters": n_clusters, "by": metric, "linkage": linkage}
        done = rows.groupBy("bucket").applyInPandas(_bucket_kernel(method, options, min_cluster_size, min_samples), f"k {kind}, bucket string, method string, label int")
    return done.select(F.col("k").alias(key), "bucket", "method", "label")


def condensed_trees(df: DataFrame, bucket: str, key: str, vector: str, min_cluster_size: int | None = None, min_samples: int = 3) -> DataFrame:
    """(bucket, parent, child, lambda_value, child_size, key): the density hierarchy of every bucket, one row per link.

    Clusters are numbered from the number of rows of the bucket on, the root first; a point's link carries its key. Buckets
    of one row have no links.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k", kind="stable")
        keys, n = frame["k"].tolist(), len(frame)
        links = condensed_tree(np.asarray(frame["v"].tolist(), dtype=np.float64), min_cluster_size or max(10, int(0.005 * n)), min_samples)
        rows = [(frame["bucket"].iloc[0], p, c, float(x), size, keys[c] if c < n else None) for p, c, x, size in links]
        return pd.DataFrame(rows, columns=["bucket", "parent", "child", "lambda_value", "child_size", "k"])

    schema = f"bucket string, parent int, child int, lambda_value double, child_size int, k {kind}"
    return _bucketed(df, bucket, key, vector).groupBy("bucket").applyInPandas(run, schema).withColumnRenamed("k", key)


def two_stage_gate(df: DataFrame, bucket: str) -> DataFrame:
    """One row (n_rows, n_buckets, two_stages): whether rows per bucket are many enough for clustering bucket by bucket."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(bucket).alias("n_buckets"))
    return counted.select("*", (F.col("n_rows") > ROWS_PER_BUCKET * F.col("n_buckets")).alias("two_stages"))


def worth_two_stages(df: DataFrame, bucket: str) -> bool:
    return two_stage_gate(df, bucket).first()["two_stages"]


def merge_names(names: DataFrame, name: str, vector: str, count: str, similarity: float = 0.85) -> DataFrame:
    """(name, canonical): names whose vectors average linkage puts together, called by the most frequent of them.

    The table of names must be a dictionary: more than MAX_KERNEL_ROWS different names are an error.
    """
    if names.count() > MAX_KERNEL_ROWS:
        raise ValueError(f"more than {MAX_KERNEL_ROWS} different names")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(name, kind="stable").reset_index(drop=True)
        frame["label"] = agglomerative(np.asarray(frame[vector].tolist(), dtype=np.float64), 1 - similarity)
        best = frame.sort_values([count, name], ascending=[False, True], kind="stable").drop_duplicates("label").set_index("label")[name]
        return pd.DataFrame({"name": frame[name], "canonical": frame["label"].map(best)})

    return names.groupBy().applyInPandas(run, "name string, canonical string")
