"""Masks, distances, clustering and stable topics of the ensemble."""

import random

import pytest
from pyspark.sql import functions as F

from topicloom.operators import ensemble as E
from topicloom.operators import pairs

TOPICS = "topic long, term_id long, w double"


def table(spark, *topics):
    return spark.createDataFrame([(t, i, w) for t, ws in enumerate(topics) for i, w in enumerate(ws) if w], TOPICS)


def kept(mask, topic=0):
    return sorted(r.term_id for r in mask.filter(f"topic = {topic}").collect())


def test_masks(spark):
    five = table(spark, (0.5, 0.3, 0.1, 0.06, 0.04))
    assert kept(E.mass_mask(five)) == [0, 1, 2]
    assert kept(E.rank_mask(five, 5)) == []
    assert kept(E.mass_mask(table(spark, (0.97, 0.03)))) == [0]
    assert kept(E.mass_mask(table(spark, (0.4, 0.2, 0.2, 0.2)))) == [0, 1, 2, 3]  # ties kept
    assert E.mask_summary(E.mass_mask(five), 5).head().percent == pytest.approx(60.0)


def test_distances(spark):
    rows = {(r.a, r.b): r.dist for r in E.topic_distance(table(spark, (0.9, 0.1, 0), (0, 0.02, 0.98)), 2).collect()}
    assert rows == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 0}
    same = {(r.a, r.b): r.dist for r in E.topic_distance(table(spark, (0.5, 0.3, 0.2), (0.5, 0.3, 0.2), (0, 0, 0, 1.0)), 3).collect()}
    assert same[0, 1] == pytest.approx(0) and same[0, 2] == 1 and all(-1e-12 <= d <= 1 for d in same.values())


def test_distances_in_tiles(spark, monkeypatch):
    rng = random.Random(4)
    topics = table(spark, *[[rng.random() for _ in range(20)] for _ in range(9)])
    want = {(r.a, r.b): round(r.dist, 9) for r in E.topic_distance(topics, 9).collect()}
    monkeypatch.setattr(pairs, "TILE", 4)
    assert {(r.a, r.b): round(r.dist, 9) for r in E.topic_distance(topics, 9).collect()} == want


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    edges = spark.range(59).filter("id <> 29").select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    labels = {r.node: r.label for r in E.components(nodes, edges).collect()}
    assert labels == {i: 0 if i < 30 else 30 for i in range(60)}


def distances(spark, near, count):
    return spark.range(count).select(F.col("id").alias("a")).crossJoin(spark.range(count).select(F.col("id").alias("b"))).select(
        "a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(
            F.when(F.struct("a", "b").isin([F.struct(F.lit(x).cast("long"), F.lit(y).cast("long")) for x, y in near]), 0.05)
            .otherwise(0.9)).alias("dist"))


def test_clusters_and_noise(spark):
    group = [(a, b) for a in range(3) for b in range(3) if a != b] + [(3, 0), (0, 3)]
    dist = distances(spark, group, 5)
    cores = E.topic_cores(dist, 0.1, 2)
    assert {r.topic for r in cores.filter("is_core").collect()} == {0, 1, 2}
    got = {r.topic: r.label for r in E.topic_clusters(dist, cores, 5, 0.1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "topic long, is_core boolean, label long, labels array<long>")


def test_validation_frees_clusters_behind(spark):
    rows = labelled(spark, [(0, True, 0, [0]), (1, True, 0, [0]), (2, True, 1, [0, 1]), (3, True, 2, [2]), (4, True, 2, [2, 1]),
                            (5, False, 0, [])])
    valid = E.valid_clusters(rows, 2)
    # cluster 1 has one core and goes first; that isolates topic 4 of cluster 2
    assert {r.label: r.is_valid for r in valid.collect()} == {0: True, 1: False, 2: True}
    assert {(r.topic, r.label) for r in E.valid_cores(rows, valid).collect()} == {(0, 0), (1, 0), (3, 2), (4, 2)}
    topics = table(spark, (1.0,), (0.5, 0.5), (1.0,), (0, 0, 1.0), (0, 0, 0, 1.0))
    stable = {(r.label, r.term_id): r.w for r in E.stable_topics(topics, E.valid_cores(rows, valid)).collect()}
    assert stable == {(0, 0): 0.75, (0, 1): 0.25, (2, 2): 0.5, (2, 3): 0.5}


def test_no_valid_cluster(spark):
    rows = labelled(spark, [(0, True, 0, [0, 1]), (1, True, 1, [0, 1])])
    valid = E.valid_clusters(rows, 1)
    # the first visited vanishes and thereby frees the second
    assert {r.label: r.is_valid for r in valid.collect()} == {0: False, 1: True}
    assert E.valid_cores(rows, E.valid_clusters(rows, 3)).count() == 0


def test_min_cores_default():
    assert [E.default_min_cores(m) for m in (1, 4, 8, 40)] == [1, 2, 3, 3]


def test_add_models_checks_the_vocabulary(spark):
    one = table(spark, (1.0,))
    assert {r.topic for r in E.add_models(one, 1, one, 3, 3).collect()} == {0, 1}
    with pytest.raises(ValueError):
        E.add_models(one, 1, one, 3, 4)


def test_ensemble_of_planted_topics(spark):
    """Four noisy copies of three topics: three stable topics come back."""
    rng = random.Random(8)
    rows = []
    for model in range(4):
        for topic in range(3):
            ws = [rng.random() * 0.02 + (1.0 if i // 5 == topic else 0.0) for i in range(15)]
            rows += [(model * 3 + topic, i, w / sum(ws)) for i, w in enumerate(ws)]
    topics = spark.createDataFrame(rows, TOPICS)
    dist = E.topic_distance(topics, 12).persist()
    clusters, valid, stable = E.recluster(topics, dist, 12, 0.1, 2, 2)
    labels = {r.topic: r.label for r in clusters.collect()}
    assert all(labels[t] == t % 3 for t in range(12))
    assert valid.filter("is_valid").count() == 3
    assert all(abs(r.s - 1) < 1e-9 for r in stable.groupBy("label").agg(F.sum("w").alias("s")).collect())


def test_fold_in_converges_to_the_right_topic(spark):
    topic_term = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (1, 1, 0.1), (1, 2, 0.9)], "topic_id int, term_id long, w double")
    docs = spark.createDataFrame([(1, 0, 5.0), (2, 2, 3.0), (3, 0, 2.0), (3, 2, 2.0), (4, 9, 1.0)], "id long, term_id long, w double")
    got = {(r.id, r.topic_id): r.p for r in E.fold_in(docs, topic_term, [0, 1], 20).collect()}
    assert got[1, 0] == pytest.approx(1) and got[2, 1] == pytest.approx(1) and got[3, 0] == pytest.approx(0.5)
    assert (4, 0) not in got
    assert E.perplexity(docs.filter("id = 1"), topic_term, [0, 1], 20).head().perplexity == pytest.approx(1 / 0.9)


def test_stacked_topics_read_the_bag_of_words_once(spark, monkeypatch):
    from topicloom.plans import catalog, corpora

    bag = spark.createDataFrame([(i, i % 5, 1 + i % 3) for i in range(60)] + [(None, 1, 2)], "id long, term_id long, n long")
    reads = []
    monkeypatch.setattr(corpora, "bow", lambda *_: reads.append(1) or bag)
    monkeypatch.setattr(corpora, "size", lambda *_: 5)
    rows = catalog.add_models(spark, "no such folder")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        ((r.topic, r.term_id, round(r.w, 6)) for r in corpora.fixed_ensemble(bag).collect() if r.topic is not None), key=str)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # the bag of words is not counted again by each reader
    assert len(reads) == 1
