"""Queries of vector clustering over the embeddings; labels are given, `vec_id % 3` stands for the sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import neighbor_graph, vectors
from reviewloom.sources.tables import table

EDGE, ADSORB, MERGE, EPS, MIN_SAMPLES = 0.3, 0.2, 0.15, 1.15, 4


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with sentiment and a label that leaves some rows as noise and some alone."""
    label = F.when(F.col("vec_id") % 11 == 0, -1).when(F.col("vec_id") % 97 == 5, F.col("vec_id").cast("int") + 1000).otherwise(F.col("label"))
    sentiment = F.element_at(F.array(F.lit("negative"), F.lit("positive"), F.lit("neutral")), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.cast("int").alias("cluster"), sentiment.alias("sentiment"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where("vec_id % 100 = 0")


def a12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.centroids(_rows(spark, sf_dir).where("cluster <> -1"), "cluster", "embedding")
    return c.select("cluster", "n", F.posexplode("centroid").alias("pos", "x")).select("cluster", "n", "pos", F.round("x", 5).alias("x"))


def x18_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the first sixteen dimensions of itself, brought to length 1, and its own reverse."""
    rows, v = _rows(spark, sf_dir), F.col("embedding")
    short = vectors.normalized(v, 16)
    return rows.select("vec_id", F.round(vectors.norm(short), 5).alias("short_norm"), F.round(vectors.cosine(v, F.reverse(v)), 5).alias("reverse_cosine"), F.round(vectors.euclidean(v, F.reverse(v)), 5).alias("reverse_distance"))


def c20_cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cluster_statistics(_rows(spark, sf_dir).where("cluster <> -1"), "cluster", "embedding", "sentiment")


def c17_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.medoids(_rows(spark, sf_dir).where("cluster <> -1"), "cluster", "vec_id", "embedding").select("cluster", "medoid")


def c18_adsorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.adsorb_noise(_rows(spark, sf_dir), "cluster", "vec_id", "embedding", ADSORB)


def c19_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.merge_small(_rows(spark, sf_dir), "cluster", "vec_id", "embedding", 2, MERGE)


def w09_dense_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dense_labels(_rows(spark, sf_dir), "vec_id", "cluster")


def w10_global_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbor_graph.offset_labels(_rows(spark, sf_dir), "sentiment", "cluster").select("vec_id", "global_label")


def c10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth."""
    near = vectors.nearest(_asked(spark, sf_dir), _rows(spark, sf_dir), "vec_id", "embedding", most=10)
    return near.select(F.col("k").alias("vec_id"), "target", F.round("score", 5).alias("score"), "rank")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every row inside its bucket, which is its sentiment."""
    rows = _rows(spark, sf_dir)
    return neighbor_graph.best_edges(rows, rows, "vec_id", "embedding", EDGE, bucket="sentiment")


def c13_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("src", "dst", F.round("score", 5).alias("score"))


def c15_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after components of the best edges took their smallest label."""
    return neighbor_graph.reconcile_labels(_rows(spark, sf_dir).select("vec_id", "cluster"), _edges(spark, sf_dir), "vec_id", "cluster")


def c08_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbor_graph.dbscan(_rows(spark, sf_dir), "vec_id", "embedding", EPS, MIN_SAMPLES)


def a19_cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of clusters: id as text, size, representatives with the medoid, and the aspect of most members."""
    rows = _rows(spark, sf_dir).where("cluster <> -1").withColumn("aspect", F.concat(F.lit("a"), F.col("vec_id") % 7))
    heads = vectors.representatives(rows, "cluster", "vec_id", "vec_id", vectors.medoids(rows, "cluster", "vec_id", "embedding"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    joined = sizes.join(heads, "cluster").join(vectors.majority(rows, "cluster", "aspect", "vec_id"), "cluster")
    return joined.select(vectors.cluster_ids(F.col("cluster")).alias("cluster_id"), F.col("aspect").alias("aspect_norm"), "cluster_size", F.array_join(F.col("ids").cast("array<string>"), ",").alias("representatives"))


def a27_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.silhouette(_rows(spark, sf_dir), "cluster", "vec_id", "embedding").select(F.round("silhouette", 5).alias("silhouette"))


QUERIES = {f.__name__: f for f in (a12_centroids, x18_similarities, c20_cluster_statistics, c17_medoids, c18_adsorbed, c19_merged, w09_dense_labels, w10_global_labels, c10_neighbours, c13_edges, c15_reconciled, c08_dbscan, a19_cluster_table, a27_silhouette)}

_ROWS = """rows AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN vec_id % 11 = 0 THEN -1 WHEN vec_id % 97 = 5 THEN CAST(vec_id AS INT) + 1000 ELSE label END AS cluster, (['negative', 'positive', 'neutral'])[vec_id % 3 + 1] AS sentiment FROM embeddings
), named AS (SELECT * FROM rows WHERE cluster <> -1),
long AS (SELECT cluster, vec_id, unnest(range(len(e))) AS pos, unnest(e) AS x FROM named),
centres AS (SELECT cluster, max(n) AS n, list(x ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(x) AS x, count(*) AS n FROM long GROUP BY 1, 2) GROUP BY 1)"""
_COS = "list_cosine_similarity({}, {})"
_MEDOIDS = """,
sums AS (SELECT cluster, list(x ORDER BY pos) AS s FROM (SELECT cluster, pos, sum(x / len) AS x FROM long JOIN (SELECT vec_id, sqrt(list_inner_product(e, e)) AS len FROM named) USING (vec_id) GROUP BY 1, 2) GROUP BY 1),
medoids AS (SELECT cluster, medoid, e FROM (SELECT cluster, vec_id AS medoid, e, row_number() OVER (PARTITION BY cluster ORDER BY round(list_inner_product(e, s) / sqrt(list_inner_product(e, e)), 9) DESC, vec_id) AS k FROM named JOIN sums USING (cluster)) WHERE k = 1)"""
_NEAR = f""",
near AS (SELECT * FROM (SELECT a.vec_id AS k, b.vec_id AS target, {_COS.format("a.e", "b.e")} AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format("a.e", "b.e")}, 9) DESC, b.vec_id) AS INT) AS rank
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10)"""
#: The 50 nearest of all rows for every row, those of its bucket that are similar enough, and the ten best of them.
_EDGES = f""",
candidates AS (SELECT * FROM (SELECT a.vec_id AS k, b.vec_id AS target, a.sentiment AS own, b.sentiment AS other, {_COS.format("a.e", "b.e")} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format("a.e", "b.e")}, 9) DESC, b.vec_id) AS place
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id) WHERE place <= 50),
kept AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) AS rank FROM candidates WHERE own = other AND score >= {EDGE}),
edges AS (SELECT least(k, target) AS src, greatest(k, target) AS dst, max(score) AS score FROM kept WHERE rank <= 10 GROUP BY 1, 2)"""

ORACLES = {
    "a12_centroids": f"WITH {_ROWS} SELECT cluster, n, CAST(pos AS INT) AS pos, round(x, 5) AS x FROM (SELECT cluster, n, unnest(range(len(c))) AS pos, unnest(c) AS x FROM centres)",
    "x18_similarities": f"""WITH {_ROWS}, short AS (SELECT vec_id, e, list_reverse(e) AS r, e[1:16] AS h FROM rows), unit AS (SELECT *, list_transform(h, lambda x: x / sqrt(list_inner_product(h, h))) AS u FROM short)
      SELECT vec_id, round(sqrt(list_inner_product(u, u)), 5) AS short_norm, round({_COS.format("e", "r")}, 5) AS reverse_cosine, round(list_distance(e, r), 5) AS reverse_distance FROM unit""",
    "c17_medoids": f"WITH {_ROWS}{_MEDOIDS} SELECT cluster, medoid FROM medoids",
    "c18_adsorbed": f"""WITH {_ROWS}{_MEDOIDS}, hits AS (SELECT * FROM (SELECT r.vec_id, m.cluster AS head, {_COS.format("r.e", "m.e")} AS s, row_number() OVER (PARTITION BY r.vec_id ORDER BY round({_COS.format("r.e", "m.e")}, 9) DESC, m.medoid) AS k
        FROM rows r JOIN medoids m ON r.cluster = -1) WHERE k = 1 AND s >= {ADSORB})
      SELECT r.vec_id, coalesce(head, r.cluster) AS new_cluster FROM rows r LEFT JOIN hits h ON r.vec_id = h.vec_id""",
    "c19_merged": f"""WITH {_ROWS}{_MEDOIDS}, sized AS (SELECT m.*, n FROM medoids m JOIN (SELECT cluster, count(*) AS n FROM named GROUP BY 1) USING (cluster)),
      hits AS (SELECT * FROM (SELECT a.cluster, b.cluster AS head, {_COS.format("a.e", "b.e")} AS s, row_number() OVER (PARTITION BY a.cluster ORDER BY round({_COS.format("a.e", "b.e")}, 9) DESC, b.medoid) AS k FROM sized a JOIN sized b ON a.n < 2 AND b.n >= 2) WHERE k = 1 AND s >= {MERGE})
      SELECT r.vec_id, CASE WHEN r.cluster <> -1 AND n < 2 THEN coalesce(head, -1) ELSE r.cluster END AS new_cluster FROM rows r LEFT JOIN sized z ON r.cluster = z.cluster LEFT JOIN hits h ON r.cluster = h.cluster""",
    "c20_cluster_statistics": f"""WITH {_ROWS}, basic AS (
        SELECT cluster, count(*) AS cluster_size, avg(CASE WHEN sentiment IN ('negative', 'neg') THEN 1.0 ELSE 0.0 END) AS neg_ratio, avg(list_distance(e, c)) AS intra, stddev_pop(list_distance(e, c)) AS spread FROM named JOIN centres USING (cluster) GROUP BY 1),
      kinds AS (SELECT cluster, -sum(p * log2(p)) AS h, count(*) AS kinds FROM (SELECT cluster, count(*) / CAST(sum(count(*)) OVER (PARTITION BY cluster) AS DOUBLE) AS p FROM named GROUP BY cluster, sentiment) GROUP BY 1),
      apart AS (SELECT a.cluster, min(list_distance(a.c, b.c)) AS inter FROM centres a JOIN centres b ON a.cluster <> b.cluster GROUP BY 1),
      totals AS (SELECT sum(intra) AS si, count(*) AS ns FROM basic WHERE cluster_size > 1),
      measured AS (SELECT *, CASE WHEN cluster_size > 1 THEN CASE WHEN intra < 0.001 THEN 10 ELSE least(inter / intra, 1000) END ELSE CASE WHEN si / ns < 0.001 THEN 10 ELSE inter / (si / ns) END END AS sep,
        (si - CASE WHEN cluster_size > 1 THEN intra ELSE 0 END) / (ns - CASE WHEN cluster_size > 1 THEN 1 ELSE 0 END) AS peers FROM basic JOIN kinds USING (cluster) JOIN apart USING (cluster), totals)
      SELECT cluster, cluster_size, round(neg_ratio, 5) AS neg_ratio, round(intra, 5) AS intra_cluster_distance, round(spread, 5) AS intra_cluster_std, round(inter, 5) AS inter_cluster_distance, round(sep, 5) AS separation_ratio,
        round(CASE WHEN cluster_size = 1 THEN 100 WHEN intra < 0.001 THEN 1000 ELSE least(1 / intra, 10000) END, 5) AS cohesion,
        round(CASE WHEN cluster_size = 1 THEN sep / (1 + sep) ELSE sep / (1 + sep) / (1 + intra / peers) END, 5) AS cluster_confidence,
        round(CASE WHEN kinds > 1 THEN 1 - h / log2(kinds) ELSE 1 END, 5) AS sentiment_consistency FROM measured""",
    "w09_dense_labels": f"WITH {_ROWS} SELECT vec_id, CAST(coalesce(d, -1) AS INT) AS dense_label FROM rows LEFT JOIN (SELECT DISTINCT cluster, dense_rank() OVER (ORDER BY cluster) - 1 AS d FROM named) USING (cluster)",
    "w10_global_labels": f"WITH {_ROWS} SELECT vec_id, CAST(coalesce(d, -1) AS INT) AS global_label FROM rows LEFT JOIN (SELECT DISTINCT sentiment, cluster, dense_rank() OVER (ORDER BY sentiment, cluster) - 1 AS d FROM named) USING (sentiment, cluster)",
    "c10_neighbours": f"WITH {_ROWS}{_NEAR} SELECT k AS vec_id, target, round(score, 5) AS score, rank FROM near",
    "c13_edges": f"WITH {_ROWS}{_EDGES} SELECT src, dst, round(score, 5) AS score FROM edges",
    "c15_reconciled": f"""WITH RECURSIVE {_ROWS}{_EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges UNION SELECT vec_id, vec_id FROM rows),
      reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
      SELECT a AS vec_id, coalesce(min(CASE WHEN cluster <> -1 THEN cluster END), -1) AS new_cluster FROM reach JOIN rows ON vec_id = b GROUP BY a""".replace("new_cluster", "new_label"),
    "a19_cluster_table": f"""WITH {_ROWS}{_MEDOIDS}, heads AS (SELECT cluster, count(*) AS n, (list(vec_id ORDER BY vec_id))[1:20] AS ids FROM named GROUP BY 1),
      aspects AS (SELECT cluster, aspect FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, first_id) AS k FROM (SELECT cluster, 'a' || CAST(vec_id % 7 AS VARCHAR) AS aspect, count(*) AS c, min(vec_id) AS first_id FROM named GROUP BY 1, 2)) WHERE k = 1)
      SELECT CAST(cluster AS VARCHAR) AS cluster_id, aspect AS aspect_norm, n AS cluster_size, array_to_string(CASE WHEN list_contains(ids, medoid) THEN ids ELSE list_concat([medoid], ids[1:19]) END, ',') AS representatives
      FROM heads JOIN medoids USING (cluster) JOIN aspects USING (cluster)""",
    "a27_silhouette": f"""WITH {_ROWS}, d AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.e, b.e) END) / nullif(count(*) FILTER (WHERE a.vec_id <> b.vec_id), 0) AS m FROM named a CROSS JOIN named b GROUP BY 1, 2, 3),
      points AS (SELECT vec_id, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM d GROUP BY 1)
      SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM points""",
    "c08_dbscan": f"""WITH RECURSIVE {_ROWS}, links AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM rows a JOIN rows b ON list_distance(a.e, b.e) <= {EPS}),
      core AS (SELECT src AS v FROM links GROUP BY 1 HAVING count(*) >= {MIN_SAMPLES}),
      among AS (SELECT src, dst FROM links WHERE src IN (SELECT v FROM core) AND dst IN (SELECT v FROM core)),
      reach AS (SELECT src, dst FROM among UNION SELECT r.src, a.dst FROM reach r JOIN among a ON r.dst = a.src),
      parts AS (SELECT src AS v, min(dst) AS c FROM reach GROUP BY 1),
      beside AS (SELECT src AS v, min(dst) AS core FROM links WHERE src NOT IN (SELECT v FROM core) AND dst IN (SELECT v FROM core) GROUP BY 1)
      SELECT vec_id, coalesce(p.c, q.c) AS cluster FROM rows LEFT JOIN parts p ON vec_id = p.v LEFT JOIN beside b ON vec_id = b.v LEFT JOIN parts q ON b.core = q.v""",
}
