"""End-to-end flows on the smallest tables, checked by what must hold of their results."""

import os

from pyspark.sql import functions as F

from topicloom.operators import topics
from topicloom.plans import catalog, corpora, flows
from topicloom.sources import posts as P

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_posts_to_topics_and_trend(spark):
    raw = P.posts(spark, DIRECTORY)
    corpus = flows.build_corpus(raw, 2012, 2021)
    run = flows.fit_topics(corpus, k=6, passes=2)
    table, trend = flows.analyse(run, raw)
    rows = table.collect()
    assert sorted(r.Document_No for r in rows) == sorted(r.id for r in raw.select("id").collect())
    assert all(r.Datetime is not None for r in rows)
    given = [r.Dominant_Topic for r in rows if r.Dominant_Topic is not None]
    assert sum(r.n for r in trend.filter("topic_id is not null").collect()) == len(given)
    shares = trend.groupBy("period").agg(F.sum("share").alias("s")).collect()
    assert shares and all(abs(r.s - 1) < 1e-6 for r in shares)


def test_posts_to_clusters_and_words(spark):
    words = catalog.QUERIES["flow_cluster_words"](spark, DIRECTORY).collect()
    clusters = {r.cluster for r in words}
    assert 1 < len(clusters) <= 7
    for cluster in clusters:
        ranked = sorted((r.rank, -r.weight) for r in words if r.cluster == cluster)
        assert [w for _, w in ranked] == sorted(w for _, w in ranked)


def test_web_posts_without_main_content_have_no_tokens(spark):
    page = "<div><a href='x'>home and other links of the site</a></div><p>The harbour lamps were glowing over the boats.</p>"
    raw = spark.createDataFrame([(1, "t", page), (2, "t", "<p>short</p>")], "id long, title string, body string")
    got = {r.id: r.tokens for r in flows.html_tokens(raw).collect()}
    assert "harbour" in got[1] and "home" not in got[1] and got[2] == []


def test_both_solvers_find_the_same_factors(spark, monkeypatch):
    vectors = corpora.model_vectors(spark, DIRECTORY)

    def values():
        return sorted(r.sigma for r in topics.fit_lsa(vectors, 5).select("factor", "sigma").distinct().collect())
    one = values()
    monkeypatch.setattr(topics, "GRAM_TERMS", 0)
    other = values()
    assert len(one) == len(other) == 5 and all(abs(a - b) < 1e-6 for a, b in zip(one, other))
