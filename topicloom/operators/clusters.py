"""Clusters of TF-IDF vectors: fitting, assignment, centroids, curves, words."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import by_row, pair_sums

K = 7
MAX_LEAVES = 2000


def non_empty(vectors: DataFrame) -> DataFrame:
    """Cosine distance is undefined for a zero vector: those are never clustered."""
    return vectors.filter(~F.col("empty"))


def unassigned(vectors: DataFrame) -> DataFrame:
    return vectors.filter("empty").select("id", F.lit(None).cast("int").alias("cluster"))


def fit_kmeans(vectors: DataFrame, k: int = K, seed: int = 1, max_iter: int = 20) -> KMeansModel:
    return KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(non_empty(vectors))


def fit_tree(vectors: DataFrame, k: int = K, seed: int = 1, max_iter: int = 20):
    """Cluster tree from the top down (a bottom-up matrix of all documents does
    not scale); :func:`merges` gives the tree over its leaves."""
    return BisectingKMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(non_empty(vectors))


def assign(model, vectors: DataFrame) -> DataFrame:
    """(id, cluster) of every document; null where the vector is empty."""
    found = model.transform(non_empty(vectors)).select("id", F.col("prediction").alias("cluster"))
    return found.unionByName(unassigned(vectors))


def sizes(doc_cluster: DataFrame) -> DataFrame:
    return doc_cluster.groupBy("cluster").agg(F.count("*").alias("n"))


def model_centroids(model) -> DataFrame:
    """(cluster, term_id, w) of a fitted model, zeros left out."""
    from pyspark.sql import SparkSession

    rows = []
    for cluster, centre in enumerate(model.clusterCenters()):
        used = np.nonzero(centre)[0]
        rows.append((cluster, used.tolist(), centre[used].tolist()))
    table = SparkSession.active().createDataFrame(rows, "cluster int, t array<long>, w array<double>")
    return table.select("cluster", F.explode(F.arrays_zip("t", "w")).alias("x")).select(
        "cluster", F.col("x.t").alias("term_id"), "x.w")


def centroids(doc_term: DataFrame, doc_cluster: DataFrame) -> DataFrame:
    """(cluster, term_id, w): sum over the documents / size of the whole cluster."""
    members = doc_cluster.filter(F.col("cluster").isNotNull())
    total = doc_term.join(members, "id").groupBy("cluster", "term_id").agg(F.sum("w").alias("s"))
    return (total.join(F.broadcast(sizes(members)), "cluster")
            .select("cluster", "term_id", (F.col("s") / F.col("n")).alias("w")))


def assign_nearest(doc_term: DataFrame, centroid_term: DataFrame, k: int) -> DataFrame:
    """(id, cluster, distance) of the nearest centroid by cosine; ties to the first.

    Centroids are laid out as one row per term with k weights, so a document
    row meets them once and is summed into k partial products before the
    shuffle, instead of being repeated k times.
    """
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("cluster")))
    unit = centroid_term.withColumn("u", F.col("w") / norm)
    slots = [F.coalesce(F.max(F.when(F.col("cluster") == i, F.col("u"))), F.lit(0.0)) for i in range(k)]
    wide = unit.groupBy("term_id").agg(*[slot.alias(f"c{i}") for i, slot in enumerate(slots)])
    joined = doc_term.join(F.broadcast(wide), "term_id", "left")
    dots = joined.groupBy("id").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"),
        *[F.sum(F.col("w") * F.coalesce(F.col(f"c{i}"), F.lit(0.0))).alias(f"d{i}") for i in range(k)])
    # cosines are compared at 12 digits, so that ties do not hang on summing order
    choices = [F.struct(F.round(1 - F.col(f"d{i}") / F.col("len"), 12).alias("distance"),
                        F.lit(i).alias("cluster")) for i in range(k)]
    best = F.array_min(F.array(*choices))
    return dots.select("id", best["cluster"].alias("cluster"), best["distance"].alias("distance"))


def cost(doc_term: DataFrame, doc_cluster: DataFrame) -> DataFrame:
    """(k, sse): half the cosine distances of the documents to their own centroid."""
    members = doc_cluster.filter(F.col("cluster").isNotNull())
    centre = centroids(doc_term, members).withColumnRenamed("w", "c")
    norm = centre.groupBy("cluster").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("cn"))
    joined = doc_term.join(members, "id").join(centre, ["cluster", "term_id"])
    dots = joined.groupBy("id", "cluster").agg(
        F.sum(F.col("w") * F.col("c")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    distance = 1 - F.col("dot") / (F.col("dn") * F.col("cn"))
    return dots.join(F.broadcast(norm), "cluster").agg(
        F.countDistinct("cluster").alias("k"), (F.sum(distance) / 2).alias("sse"))


def elbow(vectors: DataFrame, ks: Iterable[int] = range(2, 11), seed: int = 1) -> DataFrame:
    """(k, sse) over the numbers of clusters; the vectors are computed once."""
    kept = non_empty(vectors).persist()
    try:
        rows = [(k, fit_kmeans(kept, k, seed).summary.trainingCost / 2) for k in ks]
    finally:
        kept.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "k int, sse double")


def silhouette(vectors: DataFrame, ks: Iterable[int] = range(2, 11), seed: int = 1) -> DataFrame:
    """(k, score): mean cosine silhouette (a linear pass, no pairwise matrix)."""
    kept = non_empty(vectors).persist()
    judge = ClusteringEvaluator(distanceMeasure="cosine", metricName="silhouette")
    try:
        rows = [(k, judge.evaluate(fit_kmeans(kept, k, seed).transform(kept))) for k in ks]
    finally:
        kept.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "k int, score double")


def merges(doc_term: DataFrame, doc_cluster: DataFrame) -> DataFrame:
    """(step, left, right, distance, size): average-linkage tree over leaf clusters.

    For unit vectors the mean cosine distance of two clusters is
    1 - S_a . S_b / (n_a n_b) with S the vector sums, and sums simply add up when
    clusters merge: the documents are read once, the loop only touches the
    leaf-by-leaf table. Ties go to the smaller cluster numbers; the n-th merge
    is numbered (largest leaf) + n.
    """
    members = doc_cluster.filter(F.col("cluster").isNotNull())
    unit = doc_term.withColumn(
        "w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))
    joined = unit.join(members, "id")
    leaf_rows = (joined.select("id", "cluster").distinct().groupBy("cluster").agg(F.count("*").alias("n"))
                 .orderBy("cluster").limit(MAX_LEAVES + 1).collect())
    if len(leaf_rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaf clusters")
    top = max((row.cluster for row in leaf_rows), default=-1) + 1
    total = joined.groupBy("cluster", "term_id").agg(F.sum("w").alias("w"))
    rows = by_row(total, "term_id", "cluster", ["w"])
    gram = np.zeros((top, top))
    for row in pair_sums(rows, top, ["w"], ["v"], lambda cut, m: [m[:, cut].T @ m]).toLocalIterator():
        gram[row.a, row.b] = row.v
    steps = _merge_steps(gram, {row.cluster: row.n for row in leaf_rows})
    return doc_term.sparkSession.createDataFrame(
        steps, "step int, left int, right int, distance double, size long")


def _merge_steps(gram: np.ndarray, count: dict[int, int]) -> list[tuple]:
    label = {row: row for row in count}  # row of the table -> cluster number
    steps, fresh = [], max(count, default=-1) + 1
    while len(label) > 1:
        rows = sorted(label, key=label.get)
        n = np.array([count[r] for r in rows], dtype=float)
        distance = np.round(1 - gram[np.ix_(rows, rows)] / np.outer(n, n), 12)
        distance[np.tril_indices(len(rows))] = np.inf
        i, j = np.unravel_index(np.argmin(distance), distance.shape)
        left, right = rows[i], rows[j]
        gram[left] += gram[right]
        gram[:, left] += gram[:, right]
        count[left] += count[right]
        steps.append((len(steps) + 1, label[left], label[right], float(distance[i, j]), count[left]))
        label[left] = fresh
        del label[right]
        fresh += 1
    return steps


def cluster_words(doc_term: DataFrame, doc_cluster: DataFrame, terms: DataFrame, top: int = 50) -> DataFrame:
    """(cluster, rank, token, weight): mean weight * 100 of the top words."""
    mean = centroids(doc_term, doc_cluster).withColumn("weight", F.col("w") * 100)
    named = mean.join(F.broadcast(terms.select("term_id", "token")), "term_id")
    # weights are ranked at 9 digits, so that ties do not hang on summing order
    order = Window.partitionBy("cluster").orderBy(F.round("weight", 9).desc(), "token")
    return (named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("cluster", "rank", "token", "weight"))
