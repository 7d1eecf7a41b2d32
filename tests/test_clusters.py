import numpy as np
import pytest
from pyspark.sql import functions as F

import reviewloom.operators.kernels as kernels
import reviewloom.operators.neighbor_graph as neighbor_graph
import reviewloom.operators.vectors as vectors
from reviewloom.plans import clusters, models


def groups(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, set()).add(i)
    return {frozenset(v) for k, v in out.items() if k != -1}, {i for i, x in enumerate(labels) if x == -1}


def blobs(n=30, seed=1):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 5], [5, 0, 0], [0, 5, 0]])
    return np.concatenate([c + rng.normal(0, 0.2, (n, 3)) for c in centres]), np.repeat([0, 1, 2], n)


def test_agglomerative_finds_the_partition():
    x, want = blobs(10)
    assert groups(kernels.agglomerative(x, 0.3))[0] == groups(want)[0]
    assert len(groups(kernels.agglomerative(x, None, 2))[0]) == 2
    assert kernels.agglomerative(x[:1]).tolist() == [0] and kernels.agglomerative(x[:0]).tolist() == []
    assert kernels.agglomerative(np.zeros((3, 2)), 0.5).tolist() in ([0, 0, 0], [0, 1, 2])


def test_hierarchical_density_finds_the_partition_and_noise():
    x, want = blobs(30)
    x = np.concatenate([x, [[40.0, 40, 40], [-40, 7, 3]]])
    clusters, noise = groups(kernels.hdbscan(x, 10))
    assert noise >= {90, 91} and len(clusters) == 3
    for c in clusters:
        assert len({want[i] for i in c}) == 1 and len(c) > 20
    assert set(kernels.hdbscan(x[:5], 10)) == {-1}
    assert len(kernels.hdbscan(np.zeros((40, 3)), 10)) == 40


def frame(spark, x, **more):
    rows = [(i, [float(a) for a in v], *[c[i] for c in more.values()]) for i, v in enumerate(x)]
    kinds = "".join(f", {n} {'string' if isinstance(c[0], str) else 'int'}" for n, c in more.items())
    return spark.createDataFrame(rows, f"k long, v array<double>{kinds}")


@pytest.mark.parametrize("tile", [7, 2000])
def test_dbscan_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbor_graph, "TILE_ROWS", tile)
    x, _ = blobs(20, 3)
    x = np.concatenate([x, [[9.0, 9, 9], [0.9, 0, 5]]])
    d = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.6
    core = d.sum(1) >= 5
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[j] for j in np.flatnonzero(d[i] & core)] + [label[i]]) if core[i] else label[i] for i in range(len(x))])
    want = {i: int(label[i]) if core[i] else (int(label[np.flatnonzero(d[i] & core)[0]]) if (d[i] & core).any() else None) for i in range(len(x))}
    assert {r["k"]: r["cluster"] for r in neighbor_graph.dbscan(frame(spark, x), "k", "v", 0.6, 5).collect()} == want


def test_buckets_choose_their_method(spark, monkeypatch):
    monkeypatch.setattr(kernels, "SMALL", 20)
    monkeypatch.setattr(kernels, "MAX_KERNEL_ROWS", 50)
    x, want = blobs(20)
    buckets = ["one"] + ["few"] * 9 + ["some"] * 30 + ["x"] * 20
    df = frame(spark, np.concatenate([x, x]), bucket=buckets + ["many"] * 60)
    got = kernels.cluster_buckets(df, "bucket", "k", "v", min_cluster_size=5).collect()
    assert {(r["bucket"], r["method"]) for r in got} == {("one", "single"), ("few", "agglomerative"), ("some", "hdbscan"), ("x", "hdbscan"), ("many", "hdbscan")}
    many = df.where("bucket = 'many'")
    asked = {r["k"] - 60: r["label"] for r in kernels.cluster_buckets(many, "bucket", "k", "v", method="dbscan", eps=0.8).collect()}
    assert groups([asked[i] for i in range(60)])[0] == groups(want)[0] and set(asked.values()) == {0, 1, 2}
    wards = {r["k"] - 60: r["label"] for r in kernels.cluster_buckets(many.where("k < 110"), "bucket", "k", "v", method="agglomerative", n_clusters=3, linkage="ward").collect()}
    assert groups([wards[i] for i in range(50)])[0] == groups(want[:50])[0]
    assert kernels.cluster_buckets(df.limit(0), "bucket", "k", "v").count() == 0
    with pytest.raises(ValueError, match="at most 50"):
        kernels.agglomerative(x)


def test_ward_against_plain_merging():
    x = np.random.default_rng(5).normal(0, 1, (18, 3))
    parts = [[i] for i in range(18)]
    while len(parts) > 4:
        cost = {(i, j): len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum() for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j}
        i, j = min(cost, key=cost.get)
        parts[i] += parts.pop(j)
    assert groups(kernels.agglomerative(x, None, 4, linkage="ward"))[0] == {frozenset(p) for p in parts}


def test_condensed_trees_as_a_table(spark):
    x, _ = blobs(20)
    df = frame(spark, np.concatenate([x, x[:1]]), bucket=["a"] * 60 + ["b"])
    rows = kernels.condensed_trees(df, "bucket", "k", "v", 10).collect()
    assert {r["bucket"] for r in rows} == {"a"}
    assert sorted(r["k"] for r in rows if r["child"] < 60) == list(range(60)) and sum(r["child"] > 60 for r in rows) == 4
    assert {r["parent"] for r in rows} >= {60} and all(r["lambda_value"] > 0 for r in rows)


def test_nearest_in_tiles(spark, monkeypatch):
    x, _ = blobs(12, 5)
    df = frame(spark, x)
    cos = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = cos @ cos.T
    np.fill_diagonal(cos, -9)
    monkeypatch.setattr(vectors, "TILE_ROWS", 7)
    monkeypatch.setattr(vectors, "TILE_TARGETS", 5)
    for held in (0, 10**6):
        got = vectors.nearest(df, df, "k", "v", most=3, broadcast_bytes=held).collect()
        best = {i: [r["target"] for r in sorted(got, key=lambda r: r["rank"]) if r["k"] == i] for i in range(36)}
        assert best == {i: np.argsort(-np.round(cos[i], 9), kind="stable")[:3].tolist() for i in range(36)}
    assert vectors.nearest(df, df.limit(0), "k", "v").count() == 0
    assert vectors.nearest(df.limit(1), df.limit(1), "k", "v").count() == 0


def test_medoid_is_the_member_of_highest_similarity(spark):
    x, want = blobs(15, 7)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["c"]: r["medoid"] for r in vectors.medoids(frame(spark, x, c=[int(a) for a in want]), "c", "k", "v").collect()}
    for c, m in got.items():
        members = np.flatnonzero(want == c)
        sim = unit[members] @ unit[members].T
        np.fill_diagonal(sim, 0)
        assert m == members[np.argmax(np.round(sim.sum(1), 9))]


def test_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HELD_SUMS", 3)
    df = spark.createDataFrame([(i % 7 if i % 7 else None, [float(i), 1.0]) for i in range(60)] + [(1, None)], "c int, v array<double>").repartition(3)
    want = {k: (len(g := [i for i in range(60) if (i % 7 or None) == k]), [float(sum(g)), float(len(g))]) for k in (None, *range(1, 7))}
    assert {r["c"]: (r["n"], r["total"]) for r in vectors.sums(df, "c", "v").collect()} == want


def test_representatives_and_majority(spark):
    df = spark.createDataFrame([(1, i, f"a{i % 3}") for i in range(30)] + [(2, 99, "z"), (2, 98, "y")], "c int, k int, a string")
    heads = spark.createDataFrame([(1, 25), (2, 98)], "c int, medoid int")
    got = {r["c"]: r["ids"] for r in vectors.representatives(df, "c", "k", "k", heads).collect()}
    assert got == {1: [25, *range(19)], 2: [98, 99]}
    assert {r["c"]: r["ids"] for r in vectors.representatives(df, "c", "k", "k", most=2).collect()} == {1: [0, 1], 2: [98, 99]}
    assert {r["c"]: r["a"] for r in vectors.majority(df, "c", "a", "k").collect()} == {1: "a0", 2: "y"}


def test_silhouette(spark, monkeypatch):
    x, want = blobs(12, 6)
    labels = [int(a) for a in want[:-1]] + [-1]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    kept, scores = [i for i in range(36) if labels[i] >= 0], []
    for i in kept:
        mean = {c: np.mean([d[i, j] for j in kept if labels[j] == c and j != i]) for c in range(3)}
        a, b = mean[labels[i]], min(v for c, v in mean.items() if c != labels[i])
        scores.append((b - a) / max(a, b))
    df = frame(spark, x, c=labels)
    monkeypatch.setattr(vectors, "TILE_ROWS", 9)
    monkeypatch.setattr(vectors, "TILE_TARGETS", 8)
    assert abs(vectors.silhouette(df, "c", "k", "v").first()[0] - np.mean(scores)) < 1e-9
    assert vectors.silhouette(df.where("c < 1"), "c", "k", "v").first()[0] == -1.0 == vectors.silhouette(df.limit(0), "c", "k", "v").first()[0]


def test_statistics_of_odd_clusters(spark):
    df = frame(spark, [[0.0, 0], [0, 0], [3, 4]], c=[1, 1, 2], s=["negative", "positive", "neg"])
    got = {r["c"]: r for r in vectors.cluster_statistics(df, "c", "v", "s").collect()}
    assert (got[1]["cohesion"], got[1]["separation_ratio"], got[1]["sentiment_consistency"]) == (1000.0, 10.0, 0.0)
    assert (got[2]["cluster_size"], got[2]["cohesion"], got[2]["neg_ratio"], got[2]["separation_ratio"]) == (1, 100.0, 1.0, 10.0)
    alone = vectors.cluster_statistics(df.where("c = 2"), "c", "v", "s").collect()[0]
    assert (alone["cluster_confidence"], alone["separation_ratio"]) == (0.3, 0.0)
    assert vectors.cluster_statistics(df.limit(0), "c", "v", "s").count() == 0


def test_zero_vectors(spark):
    df = frame(spark, [[0.0, 0], [1, 0]])
    r = df.select(vectors.cosine(F.col("v"), F.col("v")).alias("c"), vectors.normalized(F.col("v"), 1).alias("n")).collect()
    assert [x["c"] for x in r] == [0.0, 1.0] and [x["n"] for x in r] == [[0.0], [1.0]]


def test_reconciled_labels(spark):
    labels = spark.createDataFrame([(1, 5), (2, -1), (3, 7), (4, -1), (5, -1), (6, 9)], "k long, c int")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 5, 0.9)], "src long, dst long, score double")
    got = neighbor_graph.reconcile_labels(labels, edges, "k", "c")
    assert {tuple(r) for r in got.collect()} == {(1, 5), (2, 5), (3, 5), (4, -1), (5, -1), (6, 9)}


def test_every_row_gets_its_edges_inside_its_bucket(spark, tmp_path):
    rng = np.random.default_rng(11)
    ids = [i for i in range(1, 241) if i % 100]
    centres = rng.normal(0, 1, (12, 8))
    x = np.array([centres[i % 12] + rng.normal(0, 0.5, 8) for i in ids])
    rows = [(i, [float(a) for a in v], i % 5) for i, v in zip(ids, x, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    np.fill_diagonal(cos, -9)
    want = set()
    for i, k in enumerate(ids):
        near = [j for j in np.argsort(-cos[i], kind="stable")[:50] if cos[i, j] >= clusters.EDGE and ids[j] % 3 == k % 3][:10]
        want |= {(min(k, ids[j]), max(k, ids[j])) for j in near}
    assert {(r["src"], r["dst"]) for r in clusters.c13_edges(spark, str(tmp_path)).collect()} == want and len(want) > 100
    label = {k: -1 if k % 11 == 0 else k + 1000 if k % 97 == 5 else k % 5 for k in ids}
    part = {k: k for k in ids}
    for _ in ids:
        for a, b in want:
            part[a] = part[b] = min(part[a], part[b])
    least = {p: min([label[k] for k in ids if part[k] == p and label[k] != -1], default=-1) for p in set(part.values())}
    assert {tuple(r) for r in clusters.c15_reconciled(spark, str(tmp_path)).collect()} == {(k, least[part[k]]) for k in ids}


def test_a_large_bucket_is_clustered_by_the_method_asked_for(spark, monkeypatch, tmp_path):
    x, _ = blobs(30, 4)
    x = np.concatenate([x, np.random.default_rng(2).uniform(-6, 6, (30, 3))])
    want = kernels.hdbscan(x, 5).tolist()
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(kernels, "MAX_KERNEL_ROWS", 50)
    assert kernels.hdbscan(x, 5).tolist() == want and len(set(want)) > 2
    got = {r["vec_id"]: (r["method"], r["label"]) for r in models.c07_hierarchical_density(spark, str(tmp_path)).collect()}
    assert got == {i: ("hdbscan", c) for i, c in enumerate(want)}


def test_reranked_edges_against_brute_force(spark):
    from reviewloom.operators.providers import CosineReranker, HashedNgrams

    texts = ["lid broke", "lid broken", "the lid broke", "too loud", "very loud", "so loud", "lid broke off", "loud"]
    v = HashedNgrams().encode(texts)
    rows = [(i, [float(a) for a in x], t, ["a", "b", None][i % 3]) for i, (x, t) in enumerate(zip(v, texts, strict=True))]
    df = spark.createDataFrame(rows, "k long, v array<double>, t string, b string")
    score, want = v @ v.T, {}
    for i in range(8):
        near = [j for j in np.argsort(-np.round(score[i], 9), kind="stable") if j != i][:6]
        kept = sorted((j for j in near if j % 3 == i % 3 and score[i, j] >= 0.3), key=lambda j: (-score[i, j], j))[:1]
        want |= {(min(i, j), max(i, j)): score[i, j] for j in kept}
    got = {(r["src"], r["dst"]): r["score"] for r in neighbor_graph.reranked_edges(df, "k", "v", "t", "b", CosineReranker, 0.3, 1, 6).collect()}
    assert got.keys() == want.keys() and len(got) > 1 and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert neighbor_graph.reranked_edges(df.limit(0), "k", "v", "t", "b", CosineReranker).count() == 0


def test_rows_of_reranked_edges_are_made_once(spark):
    from reviewloom.operators.providers import CosineReranker, HashedNgrams

    texts = [f"{a} {b}" for a in ("lid", "motor", "strap") for b in ("broke", "broken", "broke off", "is loud", "is very loud", "slips")] + [None]
    v = HashedNgrams().encode([t or "" for t in texts])
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = [(i, [float(a) for a in x], t, ["a", None][i % 2]) for i, (x, t) in enumerate(zip(v, texts, strict=True))]
    df = spark.createDataFrame(rows, "k long, v array<double>, t string, b string").mapInPandas(counted, "k long, v array<double>, t string, b string")
    edges = neighbor_graph.reranked_edges(df, "k", "v", "t", "b", CosineReranker, 0.3, 2, 8)
    held = {(r["src"], r["dst"]): r["score"] for r in edges.collect()}
    assert made.value == len(rows)
    tiled = {(r["src"], r["dst"]): r["score"] for r in neighbor_graph.reranked_edges(df, "k", "v", "t", "b", CosineReranker, 0.3, 2, 8, held_bytes=0).collect()}
    assert held.keys() == tiled.keys() and len(held) > 9 and all(abs(held[p] - tiled[p]) < 1e-12 for p in held)


@pytest.mark.parametrize("by", ["cosine", "distance", "dot"])
def test_best_targets_against_a_sort(monkeypatch, by):
    monkeypatch.setattr(vectors, "BLOCK", 24)
    monkeypatch.setattr(vectors, "PAIRS", 50)
    random = np.random.default_rng(3)
    x = random.integers(-2, 3, (150, 4)).astype(float)  # many ties, equal rows and rows of zeros
    x[[7, 90]] = 0
    ids = np.array(sorted(f"k{i}" for i in range(150)), dtype=object)
    score = np.round(vectors._scores(x, x, by), 9)
    np.fill_diagonal(score, -np.inf)
    for most in (1, 5, 40, 200):
        want = [np.argsort(-s, kind="stable")[: min(most, 149)].tolist() for s in score]
        i, t, s = vectors.Targets(ids, x, by).best(ids.tolist(), x, most)
        assert [t[i == n].tolist() for n in range(150)] == want
        assert np.allclose(s, score[i, t], atol=1e-8)
    i, t, _ = vectors.Targets(ids, np.where(x == 2, np.nan, x), by).best(["other"], np.ones((1, 4)), 3)
    assert len(t) == 3 and not (x[t] == 2).any()
