"""Vector arithmetic, nearest neighbours, medoids, and statistics of given clusters.

Few targets, by a checked size in bytes, are held by every worker. Beyond that both sides are cut into tiles of bounded size,
and each pair of tiles is one product of matrices on some executor. Only best matches leave a worker, so a pair that is no
match is never written or shuffled.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.ordering import dense_ranks

#: Bytes of target vectors up to which every worker holds all of them.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows and targets of a tile (about 4 MB of vectors at 64 dimensions).
TILE_ROWS, TILE_TARGETS = 4096, 4096
#: Groups whose sums a worker holds before it hands them on.
HELD_SUMS = 50_000
#: Rows that are multiplied with a tile at a time (about 16 MB of scores).
STRIPE = 512
#: Targets of a product (8 MB of scores in single precision), and pairs whose scores are computed at once in double precision.
BLOCK, PAIRS = 4096, 65_536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda t, x: t + x * x))


def normalized(a: Column, dimensions: int | None = None) -> Column:
    """Vector cut to its first dimensions and scaled to length 1; a zero vector stays zero."""
    cut = a if dimensions is None else F.slice(a, 1, dimensions)
    length = norm(cut)
    return F.transform(cut, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def _partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[object, list] = {}

    def handed_on() -> pd.DataFrame:
        rows = [(k, n, v) for k, (n, v) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["k", "n", "v"])

    for frame in frames:
        if len(frame):
            codes, keys = pd.factorize(frame["k"], use_na_sentinel=False)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
            totals = np.add.reduceat(np.asarray(frame["v"].tolist(), dtype=np.float64)[order], starts, axis=0)
            for key, n, total in zip(keys, np.bincount(codes), totals, strict=True):
                key = None if pd.isna(key) else key
                n_held, v_held = held.get(key, (0, 0.0))
                held[key] = [n_held + int(n), v_held + total]
        if len(held) > HELD_SUMS:
            yield handed_on()
    yield handed_on()


def sums(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise sums per key: (key, n, total). Each partition adds its vectors in batches; only its sums are shuffled.

    NULL vectors are left out; NULL keys are one group. All vectors must be of one length.
    """
    kind = df.schema[key].dataType.simpleString()
    parts = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(_partial_sums, f"k {kind}, n bigint, v array<double>")
    long = parts.select("k", "n", F.posexplode("v").alias("pos", "x"))
    added = long.groupBy("k", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return added.groupBy(F.col("k").alias(key)).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total"))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, centroid): element-wise means per key."""
    return sums(df, key, vector).select(key, "n", F.transform("total", lambda x: x / F.col("n")).alias("centroid"))


def _scores(rows: np.ndarray, block: np.ndarray, by: str) -> np.ndarray:
    products = rows @ block.T
    if by == "dot":
        return products
    lengths = np.linalg.norm(rows, axis=1)[:, None], np.linalg.norm(block, axis=1)[None, :]
    if by == "cosine":
        scale = lengths[0] * lengths[1]
        return np.divide(products, scale, out=np.zeros_like(products), where=scale > 0)
    return -np.sqrt(np.maximum(lengths[0] ** 2 + lengths[1] ** 2 - 2 * products, 0))


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells of a mask, looked for eight cells at a time."""
    if mask.shape[1] % 8:
        return np.nonzero(mask)
    eights = np.flatnonzero(mask.view(np.uint64))
    n, within = np.nonzero(mask.reshape(-1, 8)[eights])
    return np.divmod(eights[n] * 8 + within, mask.shape[1])


class Targets:
    """Vectors to search, known by their ids in order, held in an order without pattern: what is near a row is spread evenly over all blocks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray | Iterator[np.ndarray], by: str) -> None:
        """vectors: a row per id, or parts that hold the rows one after the other, of which one is in memory at a time."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.by = ids[order], by
        self.place = np.random.default_rng(0).permutation(len(ids))
        self.at: dict[object, list[int]] = {}
        for p, i in enumerate(self.ids[self.place]):
            self.at.setdefault(i, []).append(p)
        spot, start = np.empty(len(ids), dtype=np.int64), 0
        spot[order[self.place]] = np.arange(len(ids))
        for part in [vectors] if isinstance(vectors, np.ndarray) else vectors:
            if not start:
                self.vectors, self.lengths, self.quick = np.zeros((len(ids), part.shape[1])), np.zeros(len(ids)), np.zeros((len(ids) if by == "cosine" else 0, part.shape[1]), dtype=np.float32)
            at = spot[start : start + len(part)]
            self.vectors[at], self.lengths[at] = part, np.linalg.norm(part, axis=1)
            if by == "cosine":
                self.quick[at] = self._unit(part, self.lengths[at])
            start += len(part)

    @staticmethod
    def _unit(vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.divide(vectors, lengths[:, None], out=np.zeros_like(vectors), where=lengths[:, None] > 0).astype(np.float32)

    def _exact(self, rows: np.ndarray, lengths: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0)]
        for n in range(0, len(i), PAIRS):
            a, b = i[n : n + PAIRS], p[n : n + PAIRS]
            products, scale = np.einsum("ij,ij->i", rows[a], self.vectors[b]), lengths[a] * self.lengths[b]
            parts.append(np.divide(products, scale, out=np.zeros_like(products), where=scale > 0))
        return np.concatenate(parts)

    def best(self, keys: list, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of each row's best targets as places in `keys` and `ids`, the best first, of equal scores the smaller id.

        Cosines are first computed in single precision: a pair stays out if it is below what the row has `most` of, by more than
        twice the error of that precision. The scores of all others are computed in double precision, and these decide.
        """
        cosine = self.by == "cosine"
        error = (rows.shape[1] + 8) * 2.0**-22 if cosine else 0.0
        if cosine:
            lengths = np.linalg.norm(rows, axis=1)
            quick = self._unit(rows, lengths)
        own = np.array([(i, p) for i, k in enumerate(keys) for p in self.at.get(k, ())], dtype=np.int64).reshape(-1, 2)
        floor = np.full(len(rows), -np.inf)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        waiting = 0
        for start in range(0, len(self.ids), BLOCK):
            stop = start + BLOCK
            rough = quick @ self.quick[start:stop].T if cosine else _scores(rows, self.vectors[start:stop], self.by)
            mine = own[(own[:, 1] >= start) & (own[:, 1] < stop)]
            rough[mine[:, 0], mine[:, 1] - start] = -np.inf
            if np.isneginf(floor).any() and rough.shape[1] >= most:
                floor = np.maximum(floor, np.partition(np.where(np.isnan(rough), -np.inf, rough), -most, axis=1)[:, -most] - error - 1e-9)
            i, p = _where(rough >= np.maximum(floor - error, -1e30)[:, None].astype(rough.dtype))
            found.append((i, p + start, self._exact(rows, lengths, i, p + start) if cosine else rough[i, p]))
            waiting += len(i)
            if waiting > most * len(rows) or stop >= len(self.ids):
                i, p, s = (np.concatenate(x) for x in zip(*found, strict=True))
                i, p, s = (x[np.isfinite(s)] for x in (i, p, s))
                order = np.lexsort((self.place[p], -np.round(s, 9), i))
                i, p, s = i[order], p[order], s[order]
                kept = np.arange(len(i)) - np.searchsorted(i, np.arange(len(rows)))[i] < most
                i, p, s = i[kept], p[kept], s[kept]
                full = np.bincount(i, minlength=len(rows)) == most
                floor[full] = np.round(s, 9)[np.cumsum(np.bincount(i, minlength=len(rows)))[full] - 1] - 1e-9
                found, waiting = [(i, p, s)], 0
        i, p, s = found[0]
        return i, self.place[p], s


def _top(keys: list, vectors: np.ndarray, targets: Targets, most: int) -> Iterator[pd.DataFrame]:
    """Best targets of each row, of equal scores the smaller id first."""
    for start in range(0, len(keys), STRIPE):
        part = keys[start : start + STRIPE]
        i, t, s = targets.best(part, vectors[start : start + STRIPE], most)
        yield pd.DataFrame({"k": np.array(part, dtype=object)[i], "target": targets.ids[t], "score": s})


def _sorted_targets(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    frame = frame.sort_values("k", kind="stable")
    ids = np.empty(len(frame), dtype=object)
    ids[:] = frame["k"].tolist()
    return ids, np.asarray(frame["v"].tolist(), dtype=np.float64)


def _against_all(held: pd.DataFrame, by: str, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    ids, vectors = _sorted_targets(held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        targets = Targets(ids, vectors, by)
        for frame in frames:
            if len(frame):
                yield from _top(frame["k"].tolist(), np.asarray(frame["v"].tolist(), dtype=np.float64), targets, most)

    return run


def _against_tile(by: str, most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        if frame.empty or tile.empty:
            return pd.DataFrame({"k": frame["k"].iloc[:0], "target": tile["k"].iloc[:0], "score": pd.Series(dtype="float64")})
        parts = _top(frame["k"].tolist(), np.asarray(frame["v"].tolist(), dtype=np.float64), Targets(*_sorted_targets(tile), by), most)
        return pd.concat(parts, ignore_index=True)

    return run


def tile_pairs(left: DataFrame, right: DataFrame, n_left: int, n_right: int, left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (t, u): each row of the left in a tile t against every tile u, each row of the right the other way."""
    t, u = max(1, -(-n_left // left_rows)), max(1, -(-n_right // right_rows))
    tile = lambda n: F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return left.select("*", tile(t).alias("t")).select("*", every(u).alias("u")), right.select("*", tile(u).alias("u")).select("*", every(t).alias("t"))


def nearest(rows: DataFrame, targets: DataFrame, key: str, vector: str, by: str = "cosine", most: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(k, target, score, rank) of the `most` best targets of each row; a row is never its own target.

    by: dot, cosine, or distance (score is the negative Euclidean distance). Ties go to the smaller target. Rows without
    any other target are not returned; NULL vectors are left out on both sides. The search is exact: targets beyond
    `broadcast_bytes` are compared tile by tile on all executors, and the best of the tiles are merged.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"k {kind}, target {kind}, score double"
    own, other = (df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")) for df in (rows, targets))
    size = other.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("cells")).first()
    if (size["cells"] or 0) * 8 <= broadcast_bytes:
        if not size["n"]:
            return own.select("k", F.col("k").alias("target"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
        found = own.mapInPandas(_against_all(other.toPandas(), by, most), schema)
    else:
        left, right = tile_pairs(own, other, own.count(), size["n"], TILE_ROWS, TILE_TARGETS)
        found = left.groupBy("t", "u").cogroup(right.groupBy("t", "u")).applyInPandas(_against_tile(by, most), schema)
    order = Window.partitionBy("k").orderBy(F.desc(F.round("score", 9)), "target")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def near_pairs(df: DataFrame, most: int, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What `run` makes of the pairs of each row and its `most` nearest other rows by cosine, if both are in one bucket.

    df: k (unique), v, bucket, text; the bucket is text, and NULL is a bucket. `run` gets the whole of a row's pairs in one frame of
    (i, k, text, place, target, other_text), i and place being numbers in the order of the rows and of the keys. Every worker
    holds all vectors, buckets and texts, as flat arrays, so that no pair is moved before `run` has seen it.
    """
    rows = df.select("k", F.col("v").cast("array<double>").alias("v"), "bucket", "text")
    context = df.sparkSession.sparkContext
    # compressed where they are, as the driver passes them on
    sent = context.broadcast({"parts": [(bytes(r["head"]), bytes(r["vectors"])) for r in rows.mapInPandas(_packed, "head binary, vectors binary").collect()]})
    tasks = max(2 * context.defaultParallelism, -(-rows.count() // TILE_ROWS))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        if "targets" not in held:  # once for all tasks of a worker
            held["targets"] = _unpacked(held["parts"])
        targets, buckets, texts = held["targets"]
        for frame in frames:
            for start in range(0, len(frame), STRIPE):
                part = frame.iloc[start : start + STRIPE]
                i, t, _ = targets.best(part["k"].tolist(), np.asarray(part["v"].tolist(), dtype=np.float64), most)
                own = part["bucket"].to_numpy(dtype=object)
                same = own[i] == buckets[t]
                i, t = i[same], t[same]
                yield pd.DataFrame({"i": i, "k": part["k"].to_numpy(dtype=object)[i], "text": part["text"].to_numpy(dtype=object)[i], "place": t, "target": targets.ids[t], "other_text": texts[t]})

    # rows of like texts in one task meet the same texts
    return rows.repartitionByRange(tasks, "bucket", "text", "k").mapInPandas(lambda frames: run(pairs(frames)), schema)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch of rows, its keys, buckets and texts, and its vectors, compressed."""
    for frame in frames:
        if len(frame):
            head, v = [frame[c].tolist() for c in ("k", "bucket", "text")], np.asarray(frame["v"].tolist(), dtype=np.float64)
            yield pd.DataFrame({name: [zlib.compress(pickle.dumps(x, 5), 1)] for name, x in (("head", head), ("vectors", v))})


def _unpacked(parts: list[tuple[bytes, bytes]]) -> tuple[Targets, np.ndarray, np.ndarray]:
    """The targets, and their buckets and texts in the order of the ids."""
    heads = [pickle.loads(zlib.decompress(head)) for head, _ in parts]
    ids, buckets, texts = (np.array([None, *(x for head in heads for x in head[n])], dtype=object)[1:] for n in range(3))
    del heads
    order = np.argsort(ids, kind="stable")
    return Targets(ids, (pickle.loads(zlib.decompress(v)) for _, v in parts), "cosine"), buckets[order], texts[order]


def representatives(df: DataFrame, cluster: str, key: str, order: str, medoids: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(cluster, ids): the first `most` members by `order`; a medoid that is not among them comes first instead of the last.

    medoids: cluster, medoid. Ties of the order go to the smaller key.
    """
    place = Window.partitionBy(cluster).orderBy(order, key)
    first = df.select(cluster, key, order).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= most)
    listed = first.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", key))), lambda x: x[key]).alias("ids"))
    if medoids is None:
        return listed
    with_medoid = F.when(F.col("medoid").isNull() | F.array_contains("ids", F.col("medoid")), F.col("ids")).otherwise(F.concat(F.array("medoid"), F.slice("ids", 1, most - 1)))
    return listed.join(medoids.select(cluster, "medoid"), cluster, "left").select(cluster, with_medoid.alias("ids"))


def majority(df: DataFrame, cluster: str, value: str, order: str) -> DataFrame:
    """(cluster, value): the most frequent value of each cluster, of equally frequent ones the first by `order`."""
    counts = df.groupBy(cluster, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(cluster).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value))


def cluster_ids(label: Column, noise: int = -1) -> Column:
    """Cluster id as text; noise is called so."""
    return F.when(label == noise, "noise").otherwise(label.cast("string"))


def _distance_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Per row of the left and cluster of the right, the sum of distances and their number, without the row itself."""
    if left.empty or right.empty:
        return pd.DataFrame({"k": left["k"].iloc[:0], "c": left["c"].iloc[:0], "other": right["c"].iloc[:0], "s": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})
    right = right.sort_values("c", kind="stable")
    starts = np.flatnonzero(np.r_[True, right["c"].to_numpy()[1:] != right["c"].to_numpy()[:-1]])
    names, ids, b = right["c"].to_numpy()[starts], right["k"].to_numpy(), np.asarray(right["v"].tolist(), dtype=np.float64)
    parts = []
    for i in range(0, len(left), STRIPE):
        part = left.iloc[i : i + STRIPE]
        d = -_scores(np.asarray(part["v"].tolist(), dtype=np.float64), b, "distance")
        same = part["k"].to_numpy()[:, None] == ids[None, :]
        d[same] = 0
        total, own = np.add.reduceat(d, starts, axis=1), np.add.reduceat((~same).astype(np.int64), starts, axis=1)
        n = np.repeat(np.arange(len(part)), len(names))
        parts.append(pd.DataFrame({"k": part["k"].to_numpy()[n], "c": part["c"].to_numpy()[n], "other": np.tile(names, len(part)), "s": total.ravel(), "n": own.ravel()}))
    return pd.concat(parts, ignore_index=True)


def silhouette(df: DataFrame, cluster: str, key: str, vector: str, noise: int = -1) -> DataFrame:
    """One row, silhouette: mean over all points that are no noise; -1 if there are fewer than two clusters or points to tell.

    A point alone in its cluster scores 0. Distances are computed tile by tile, and sums per point and cluster leave them.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, cluster)}
    # two selections, as both sides of a cogroup must not share their columns
    own, other = (df.where((F.col(cluster) != noise) & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vector).alias("v")) for _ in range(2))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c").alias("c")).first()
    left, right = tile_pairs(own, other, size["n"], size["n"], TILE_ROWS, TILE_TARGETS)
    parts = left.groupBy("t", "u").cogroup(right.groupBy("t", "u")).applyInPandas(_distance_sums, f"k {kinds[key]}, c {kinds[cluster]}, other {kinds[cluster]}, s double, n bigint")
    means = parts.groupBy("k", "c", "other").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
    points = means.groupBy("k").agg(F.max(F.when(F.col("c") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("other"), F.col("d"))).alias("b"))
    widest = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | (widest == 0), 0.0).otherwise((F.col("b") - F.col("a")) / widest)
    told = size["c"] >= 2 and size["n"] > size["c"]
    return points.agg((F.avg(value) if told else F.lit(-1.0)).alias("silhouette"))


def medoids(df: DataFrame, cluster: str, key: str, vector: str) -> DataFrame:
    """(cluster, medoid, vector) of each cluster: the member with the highest mean similarity to the others.

    For vectors of length 1 the sum of similarities is the product with the cluster's sum vector, so one pass suffices.
    Ties go to the smaller key.
    """
    unit = df.select(cluster, key, normalized(F.col(vector)).alias("u"))
    rated = unit.join(sums(unit, cluster, "u").select(cluster, "total"), cluster).select(cluster, key, "u", F.round(dot(F.col("u"), F.col("total")), 9).alias("s"))
    best = rated.groupBy(cluster).agg(F.min_by(F.struct(key, "u"), F.struct(-F.col("s"), key)).alias("m"))
    return best.select(cluster, F.col(f"m.{key}").alias("medoid"), F.col("m.u").alias("medoid_vector"))


def cluster_statistics(df: DataFrame, cluster: str, vector: str, sentiment: str) -> DataFrame:
    """Size, share of negatives, distances, separation, cohesion, confidence and sentiment consistency of each cluster.

    Noise must be filtered out before. The centre of a cluster of one is its point, its inner distance 0. Clusters of
    several members are separated by inter / intra (10 where intra is below 0.001, at most 1000) and cohere by 1 / intra
    (1000 where it is below 0.001, at most 10000). The confidence weighs separation against the mean inner distance of
    the other clusters of several members.
    """
    centres = centroids(df, cluster, vector)
    with_centre = df.join(centres, cluster)
    basic = with_centre.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.avg(F.when(F.col(sentiment).isin("negative", "neg"), 1.0).otherwise(0.0)).alias("neg_ratio"),
        F.avg(euclidean(F.col(vector), F.col("centroid"))).alias("intra"),
        F.stddev_pop(euclidean(F.col(vector), F.col("centroid"))).alias("intra_std"),
    )
    by_sentiment = df.groupBy(cluster, sentiment).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(cluster)
    shares = by_sentiment.withColumn("p", F.col("n") / F.sum("n").over(whole))
    entropy = shares.groupBy(cluster).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count(F.lit(1)).alias("kinds"))
    apart = nearest(centres, centres, cluster, "centroid", "distance").select(F.col("k").alias(cluster), (-F.col("score")).alias("inter"))
    rows = basic.join(entropy, cluster).join(apart, cluster, "left")
    several = F.col("cluster_size") > 1
    totals = rows.agg(F.sum(F.when(several, F.col("intra"))).alias("s"), F.count_if(several).alias("n")).first()
    rows = rows.withColumns({"sum_intra": F.lit(totals["s"]).cast("double"), "n_several": F.lit(totals["n"])})
    mean_intra = F.when(F.col("n_several") > 0, F.col("sum_intra") / F.col("n_several"))
    others = F.when(several, F.col("n_several") - 1).otherwise(F.col("n_several"))
    intra, inter = F.col("intra"), F.col("inter")
    ratio = F.when(inter.isNull(), None).when(intra < 0.001, 10.0).otherwise(F.least(inter / intra, F.lit(1000.0)))
    single = F.when(inter.isNull() | mean_intra.isNull(), F.lit(0.0)).when(mean_intra < 0.001, 10.0).otherwise(inter / mean_intra)
    separation = F.when(several, ratio).otherwise(single)
    cohesion = F.when(~several, 100.0).when(intra < 0.001, 1000.0).otherwise(F.least(1 / intra, F.lit(10000.0)))
    rows = rows.withColumns({"separation": separation, "cohesion": cohesion, "peers": F.when(others > 0, (F.col("sum_intra") - F.when(several, intra).otherwise(0.0)) / others)})
    sep = F.col("separation")
    relative = F.when(F.col("peers") > 0, intra / F.col("peers")).otherwise(1.0)
    confidence = F.when(~several, F.when(inter.isNull() | mean_intra.isNull(), 0.3).otherwise(sep / (1 + sep))).when(sep.isNull(), 0.5).when(F.col("peers").isNull(), sep / (1 + sep)).otherwise(sep / (1 + sep) / (1 + relative))
    consistency = F.when(F.col("kinds") > 1, 1 - F.col("h") / F.log2("kinds")).otherwise(1.0)
    named = {"neg_ratio": F.col("neg_ratio"), "intra_cluster_distance": intra, "intra_cluster_std": F.col("intra_std"), "inter_cluster_distance": inter, "separation_ratio": sep, "cohesion": F.col("cohesion"), "cluster_confidence": confidence, "sentiment_consistency": consistency}
    return rows.select(cluster, "cluster_size", *[F.round(c, 5).alias(n) for n, c in named.items()])


def adsorb_noise(df: DataFrame, cluster: str, key: str, vector: str, least: float = 0.7, noise: int = -1) -> DataFrame:
    """(key, new_cluster): noise joins the cluster of its nearest medoid if that is similar enough."""
    named = df.where(F.col(cluster) != noise)
    heads = medoids(named, cluster, key, vector).select(F.col("medoid").alias(key), F.col("medoid_vector").alias(vector), F.col(cluster).alias("head_cluster"))
    hits = nearest(df.where(F.col(cluster) == noise), heads, key, vector).where(F.col("score") >= least)
    moved = hits.join(heads.select(F.col(key).alias("target"), "head_cluster"), "target").select(F.col("k").alias(key), "head_cluster")
    return df.select(key, cluster).join(moved, key, "left").select(key, F.coalesce("head_cluster", cluster).alias("new_cluster"))


def merge_small(df: DataFrame, cluster: str, key: str, vector: str, smallest: int = 2, least: float = 0.75, noise: int = -1) -> DataFrame:
    """(key, new_cluster): clusters below `smallest` join the nearest large one by medoid, or become noise."""
    sizes = df.where(F.col(cluster) != noise).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    heads = medoids(df.where(F.col(cluster) != noise), cluster, key, vector).join(sizes, cluster)
    as_rows = heads.select(F.col("medoid").alias(key), F.col("medoid_vector").alias(vector), F.col(cluster).alias("head_cluster"), "n")
    small, large = as_rows.where(F.col("n") < smallest), as_rows.where(F.col("n") >= smallest)
    hits = nearest(small, large, key, vector).where(F.col("score") >= least)
    target = hits.join(large.select(F.col(key).alias("target"), F.col("head_cluster").alias("into")), "target").select(F.col("k").alias(key), "into")
    moved = small.join(target, key, "left").select(F.col("head_cluster").alias(cluster), F.coalesce("into", F.lit(noise)).alias("into"))
    return df.select(key, cluster).join(moved, cluster, "left").select(key, F.coalesce("into", cluster).alias("new_cluster"))


def dense_labels(df: DataFrame, key: str, label: str, noise: int = -1) -> DataFrame:
    """(key, dense_label): surviving labels renumbered from 0 in their order, noise kept."""
    kept = df.where(F.col(label) != noise).select(label).distinct()
    kept = dense_ranks(kept, [label], "dense_label").withColumn("dense_label", F.col("dense_label").cast("int"))
    return df.join(kept, label, "left").select(key, F.coalesce("dense_label", F.lit(noise)).alias("dense_label"))
