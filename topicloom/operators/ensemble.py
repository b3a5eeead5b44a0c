"""Ensemble of topic models: keep the topics that recur across models.

Topics of all models are one table (topic, term_id, w), topic numbered 0..T-1.
T is the number of models times their topics, so tables over pairs of topics
are bounded by the model, not by the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .pairs import all_pairs, by_row, pair_sums

MASS = 0.95
RANK = 0.11
MIN_MASKED_MASS = 0.05  # fixed value: below it two topics count as unlike
CHECK_BACK = 0.25       # fixed value: share of close parent neighbours


def stack(models: DataFrame, k: int) -> DataFrame:
    """(topic, term_id, w) from (model_id, topic_id, term_id, w)."""
    key = (F.col("model_id") * k + F.col("topic_id")).cast("long")
    return models.select(key.alias("topic"), "term_id", "w")


def mass_mask(topics: DataFrame, threshold: float = MASS) -> DataFrame:
    """Terms down to the smallest one inside the cumulative mass, ties kept.

    A topic whose first term reaches the mass keeps that term.
    """
    order = Window.partitionBy("topic").orderBy(F.col("w").desc(), "term_id")
    running = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = Window.partitionBy("topic")
    ranked = topics.withColumn("cum", running)
    least = F.coalesce(F.min(F.when(F.col("cum") < threshold, F.col("w"))).over(all_), F.max("w").over(all_))
    return ranked.withColumn("least", least).filter(F.col("w") >= F.col("least")).select("topic", "term_id", "w")


def rank_mask(topics: DataFrame, size: int | Column, threshold: float = RANK) -> DataFrame:
    """Terms strictly above the weight at rank int(size * threshold).

    ``size`` is the vocabulary size; terms without a row weigh zero.
    """
    size = F.lit(size) if isinstance(size, int) else size
    at = F.floor(size * F.lit(threshold)) + 1
    order = Window.partitionBy("topic").orderBy(F.col("w").desc(), "term_id")
    limit = F.max(F.when(F.col("place") == at, F.col("w"))).over(Window.partitionBy("topic"))
    ranked = topics.withColumn("place", F.row_number().over(order)).withColumn("edge", F.coalesce(limit, F.lit(0.0)))
    return ranked.filter(F.col("w") > F.col("edge")).select("topic", "term_id", "w")


def mask_summary(mask: DataFrame, size: int | Column) -> DataFrame:
    """(topics, percent): mean mask size in percent of the vocabulary."""
    size = F.lit(size) if isinstance(size, int) else size
    per = mask.groupBy("topic").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("topics"), (F.avg("n") * 100 / size).alias("percent"))


def _masked_products(cut: slice, w: np.ndarray, masked: np.ndarray):
    kept, mask = masked[:, cut], (masked[:, cut] > 0).astype(float)
    own = (kept * kept).sum(axis=0)[:, None] * np.ones((1, w.shape[1]))
    return kept.T @ w, own, mask.T @ (w * w), mask.T @ w


def topic_distance(topics: DataFrame, count: int, mask: DataFrame | None = None) -> DataFrame:
    """(a, b, dist): cosine distance of a and b on the terms of a's mask.

    Self distance is 0; b with at most 5 % of its mass on the mask has distance 1.
    """
    mask = mass_mask(topics) if mask is None else mask
    both = (topics.join(mask.select("topic", "term_id", F.col("w").alias("m")), ["topic", "term_id"], "left")
            .fillna(0.0, ["m"]))
    sums = pair_sums(by_row(both, "term_id", "topic", ["w", "m"]), count, ["w", "m"],
                     ["dot", "aa", "bb", "mass"], _masked_products)
    cosine = F.col("dot") / F.sqrt(F.col("aa") * F.col("bb"))
    dist = (F.when(F.col("a") == F.col("b"), 0.0)
            .when(F.coalesce("mass", F.lit(0.0)) <= MIN_MASKED_MASS, 1.0)
            .otherwise(1 - cosine))
    grid = all_pairs(topics.sparkSession, count)
    return grid.join(sums, ["a", "b"], "left").select("a", "b", dist.alias("dist"))


def distance_summary(distance: DataFrame) -> DataFrame:
    """(least, mean, most) off the diagonal; ``most`` serves as a wide eps."""
    return distance.filter("a <> b").agg(
        F.min("dist").alias("least"), F.avg("dist").alias("mean"), F.max("dist").alias("most"))


def neighbours(distance: DataFrame, eps: float) -> DataFrame:
    """(a, b): b strictly within eps of a, never a itself."""
    return distance.filter((F.col("a") != F.col("b")) & (F.col("dist") < eps)).select("a", "b")


def topic_cores(distance: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(topic, n_neighbours, is_core) of every topic."""
    near = F.sum(F.when((F.col("a") != F.col("b")) & (F.col("dist") < eps), 1).otherwise(0))
    counted = distance.groupBy(F.col("a").alias("topic")).agg(near.alias("n_neighbours"))
    return counted.withColumn("is_core", F.col("n_neighbours") >= min_samples)


def core_edges(distance: DataFrame, cores: DataFrame, count: int, eps: float,
               share: float = CHECK_BACK) -> DataFrame:
    """(parent, child, close): neighbouring cores that pass the check-back.

    Of the parent and the parent's neighbours, at least ``share`` must be
    within eps of the child. The counts are one matrix product over topics.
    """
    near = neighbours(distance, eps)
    flags = (near.select(F.col("b").alias("x"), F.col("a").alias("t"), F.lit(1.0).alias("parent"), F.lit(0.0).alias("child"))
             .unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("t"), F.lit(0.0).alias("parent"), F.lit(1.0).alias("child")))
             .unionByName(cores.select(F.col("topic").alias("x"), F.col("topic").alias("t"), F.lit(1.0).alias("parent"), F.lit(0.0).alias("child")))
             .groupBy("x", "t").agg(F.max("parent").alias("parent"), F.max("child").alias("child")))
    close = pair_sums(by_row(flags, "x", "t", ["parent", "child"]), count, ["parent", "child"], ["close"],
                      lambda cut, parent, child: [parent[:, cut].T @ child])
    core = cores.filter("is_core")
    pairs = (near.join(core.select(F.col("topic").alias("a"), "n_neighbours"), "a")
             .join(core.select(F.col("topic").alias("b")), "b", "left_semi"))
    counted = pairs.join(close, ["a", "b"], "left").fillna(0.0, ["close"])
    passed = counted.filter(F.col("close") / (F.col("n_neighbours") + 1) >= share)
    return passed.select(F.col("a").alias("parent"), F.col("b").alias("child"), F.col("close").cast("long").alias("close"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each connected component.

    Labels flow along the edges and then jump to the label of their label, so
    the rounds grow with the logarithm of the component size. Each round is
    checkpointed.
    """
    both = edges.select(F.col("parent").alias("x"), F.col("child").alias("y"))
    both = cut_lineage(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(
            F.min("label").alias("heard"))
        lowered = labels.join(heard, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = lowered.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nxt = cut_lineage(lowered.join(jump, "label", "left").select(
            "node", "old", F.least("label", "further").alias("label")))
        changed = nxt.filter("old <> label").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels


def topic_clusters(distance: DataFrame, cores: DataFrame, count: int, eps: float) -> DataFrame:
    """(topic, is_core, label): order-free check-back clustering.

    Core topics joined by passing edges share a label. A topic that is no core
    takes the label of the nearest core it neighbours, else -1.
    """
    core = cores.filter("is_core").select(F.col("topic").alias("node"))
    labels = components(core, core_edges(distance, cores, count, eps))
    named = labels.select(F.col("node").alias("topic"), F.col("label"))
    near = (distance.filter((F.col("a") != F.col("b")) & (F.col("dist") < eps))
            .join(named.withColumnRenamed("topic", "a"), "a")
            .groupBy(F.col("b").alias("topic")).agg(F.min(F.struct("dist", "a", "label"))["label"].alias("lent")))
    return (cores.select("topic", "is_core").join(named, "topic", "left").join(near, "topic", "left")
            .select("topic", "is_core", F.coalesce("label", "lent", F.lit(-1)).alias("label")))


def neighbouring_labels(clusters: DataFrame, near: DataFrame) -> DataFrame:
    """(topic, is_core, label, labels): labels of the cores that have the topic near."""
    source = clusters.filter("is_core").select(F.col("topic").alias("a"), F.col("label").alias("from"))
    seen = near.join(source, "a").groupBy(F.col("b").alias("topic")).agg(
        F.sort_array(F.collect_set("from")).alias("labels"))
    empty = F.array().cast(seen.schema["labels"].dataType)
    return clusters.join(seen, "topic", "left").withColumn("labels", F.coalesce("labels", empty))


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """(label, num_cores, max_labels) over the cores."""
    return labelled.filter("is_core").groupBy("label").agg(
        F.count("*").alias("num_cores"), F.max(F.size("labels")).alias("max_labels"))


def default_min_cores(models: int) -> int:
    return min(3, max(1, int(models / 4 + 1)))


def valid_clusters(labelled: DataFrame, min_cores: int) -> DataFrame:
    """(label, num_cores, is_valid).

    Clusters with few cores go first, and their labels vanish from all sets.
    The others are visited in order (most neighbouring labels, cores, label):
    one stays if enough of its cores then neighbour no other cluster; if not,
    its label vanishes too, which may free the clusters behind it. The order
    matters, so the loop runs over the few distinct label sets on the driver.
    """
    min_cores = max(min_cores, 1)
    rows = labelled.filter("is_core").groupBy("label", "labels").agg(F.count("*").alias("n")).collect()
    found: dict[int, list] = {}
    for row in rows:
        found.setdefault(row.label, []).append((frozenset(row.labels), row.n))
    size = {label: sum(n for _, n in sets) for label, sets in found.items()}
    most = {label: max(len(s) for s, _ in sets) for label, sets in found.items()}
    gone = {label for label in found if size[label] < min_cores}
    for label in sorted(found, key=lambda x: (most[x], size[x], x)):
        if label not in gone:
            isolated = sum(n for s, n in found[label] if s - gone == {label})
            if isolated < min_cores:
                gone.add(label)
    out = [(label, size[label], label not in gone) for label in sorted(found)]
    return labelled.sparkSession.createDataFrame(out, "label long, num_cores long, is_valid boolean")


def valid_cores(labelled: DataFrame, valid: DataFrame) -> DataFrame:
    """(topic, label): cores whose only valid neighbouring label is their own."""
    good = valid.filter("is_valid").agg(
        F.coalesce(F.collect_set("label"), F.array().cast("array<bigint>")).alias("good")).scalar()
    left = F.array_intersect(F.col("labels").cast("array<bigint>"), good)
    return labelled.filter("is_core").filter(left == F.array(F.col("label").cast("long"))).select("topic", "label")


def stable_topics(topics: DataFrame, cores: DataFrame) -> DataFrame:
    """(label, term_id, w): mean topic of the valid cores of each cluster."""
    n = cores.groupBy("label").agg(F.count("*").alias("n"))
    sums = topics.join(F.broadcast(cores), "topic").groupBy("label", "term_id").agg(F.sum("w").alias("s"))
    return sums.join(F.broadcast(n), "label").select("label", "term_id", (F.col("s") / F.col("n")).alias("w"))


def recluster(topics: DataFrame, distance: DataFrame, count: int, eps: float = 0.1, min_samples: int = 2,
              min_cores: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, valid, stable) under new settings, from stored distances."""
    cores = topic_cores(distance, eps, min_samples)
    clusters = cut_lineage(topic_clusters(distance, cores, count, eps))
    labelled = neighbouring_labels(clusters, neighbours(distance, eps))
    valid = valid_clusters(labelled, min_cores)
    return clusters, valid, stable_topics(topics, valid_cores(labelled, valid))


def add_models(old: DataFrame, old_count: int, new: DataFrame, old_size: int, new_size: int) -> DataFrame:
    """Stack more topics onto the ensemble; both must share one vocabulary."""
    if old_size != new_size:
        raise ValueError(f"vocabulary sizes differ: {old_size} and {new_size}")
    return old.unionByName(new.withColumn("topic", F.col("topic") + old_count))


def _fold(doc_term: DataFrame, topic_term: DataFrame, topics: list[int], iterations: int) -> DataFrame:
    """Rows of doc_term with the document's topic shares t0.. and weights p0.. ."""
    k = range(len(topics))
    slots = [F.coalesce(F.max(F.when(F.col("topic_id") == t, F.col("w"))), F.lit(0.0)).alias(f"p{i}")
             for i, t in enumerate(topics)]
    wide = topic_term.groupBy("term_id").agg(*slots)
    # dealt by document while the rows are narrow: behind the look-up they carry 2k weights
    rows = doc_term.select("id", "term_id", F.col("w").alias("c")).repartition("id").join(F.broadcast(wide), "term_id")
    rows = rows.filter(sum(F.col(f"p{i}") for i in k) > 0)
    rows = rows.select("id", "c", *[f"p{i}" for i in k], *[F.lit(1.0 / len(topics)).alias(f"t{i}") for i in k])
    document = Window.partitionBy("id")
    for _ in range(iterations):
        mixed = sum(F.col(f"t{i}") * F.col(f"p{i}") for i in k)
        rows = rows.withColumn("q", F.col("c") / mixed)
        rows = rows.select("id", "c", *[f"p{i}" for i in k], *[
            (F.sum(F.col("q") * F.col(f"t{i}") * F.col(f"p{i}")).over(document) / F.sum("c").over(document)).alias(f"t{i}")
            for i in k])
    return rows


def fold_in(doc_term: DataFrame, topic_term: DataFrame, topics: list[int], iterations: int = 20) -> DataFrame:
    """(id, topic_id, p): documents inferred on fixed topics by EM.

    The topics are laid out as one row per term (bounded by the vocabulary).
    All iterations run as windows over the document, behind a single shuffle.
    """
    rows = _fold(doc_term, topic_term, topics, iterations)
    per_doc = rows.groupBy("id").agg(*[F.first(f"t{i}").alias(f"t{i}") for i in range(len(topics))])
    pairs = F.array(*[F.struct(F.lit(t).alias("topic_id"), F.col(f"t{i}").alias("p")) for i, t in enumerate(topics)])
    return per_doc.select("id", F.explode(pairs).alias("x")).select("id", "x.topic_id", "x.p")


def perplexity(doc_term: DataFrame, topic_term: DataFrame, topics: list[int], iterations: int = 20) -> DataFrame:
    """(perplexity): exp(-sum(c ln p) / sum c) of the documents folded in."""
    rows = _fold(doc_term, topic_term, topics, iterations)
    p = sum(F.col(f"t{i}") * F.col(f"p{i}") for i in range(len(topics)))
    return rows.agg(F.exp(-F.sum(F.col("c") * F.log(p)) / F.sum("c")).alias("perplexity"))
