"""Phrases, vectors, clusters, topics: brute force, invariants, planted structure."""

import itertools
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from topicloom.operators import analysis as A
from topicloom.operators import clusters as C
from topicloom.operators import coherence as CO
from topicloom.operators import ensemble as E
from topicloom.operators import phrases as G
from topicloom.operators import topics as TP
from topicloom.operators import vectors as V
from topicloom.runtime import run_path
from topicloom.plans import flows

DOCS = "id long, tokens array<string>"


def make(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), DOCS)


@pytest.fixture(scope="module")
def planted(spark):
    """3 groups of 40 documents with disjoint vocabularies of 10 words."""
    rng = random.Random(3)
    docs = make(spark, [[f"w{g}{rng.randrange(10)}" for _ in range(30)] for g in range(3) for _ in range(40)] + [["none"]])
    docs = docs.repartition(4, "id").persist()
    terms = V.prune(V.dictionary(docs), V.count_docs(docs), no_below=5).persist()
    vectors = V.vectors(docs, terms).persist()
    return docs, terms, vectors, V.weigh(docs, terms, 121).persist()


# --- phrases -------------------------------------------------------------

@pytest.mark.parametrize("text, want", [
    ("a b c d", ["a_b", "c_d"]), ("a b c", ["a_b"]), ("x a b x b c", ["a_b", "b_c"]), ("p_q a", ["p_q"]), ("a", []), ("", [])])
def test_greedy_merge(spark, text, want):
    phrases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    docs = make(spark, [text.split()])
    assert G.appended(G.merge_phrases(docs, phrases)).head().appended == want


def test_greedy_merge_against_a_loop(spark):
    rng = random.Random(1)
    docs = [[rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(200)]
    chosen = {("a", "b"), ("b", "c"), ("a", "a"), ("d", "a")}

    def loop(tokens):
        out, i = [], 0
        while i < len(tokens):
            if tuple(tokens[i:i + 2]) in chosen:
                out.append("_".join(tokens[i:i + 2]))
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        return out

    merged = G.merge_phrases(make(spark, docs), spark.createDataFrame(list(chosen), "a string, b string"))
    assert {r.id: r.tokens for r in merged.collect()} == {i: loop(d) for i, d in enumerate(docs)}


def test_phrase_arguments_are_honoured(spark):
    docs = make(spark, [["x", "y", "z"]] * 4 + [["q"]] * 20)
    assert G.phrase_scores(docs).count() == 0
    assert {(r.a, r.b) for r in G.phrase_scores(docs, 2, 0.1).collect()} == {("x", "y"), ("y", "z")}
    tri = G.ngram_docs(docs, "t", 2, 0.1).filter("id = 0").head().tokens
    assert tri == ["x", "y", "z", "x_y_z"]


# --- dictionary and vectors ----------------------------------------------

def test_tfidf_small(spark):
    docs = make(spark, [["u", "v"], ["v"], ["n"], ["n"]])
    terms = V.prune(V.dictionary(docs), 4, no_below=1)
    rows = V.weigh(docs.filter("id = 0"), terms, 4).collect()
    raw = np.array([2.0, 1.0])
    assert sorted(round(r.w, 6) for r in rows) == sorted(np.round(raw / np.linalg.norm(raw), 6))


def test_prune_limits(spark):
    docs = make(spark, [["a", "b", f"r{i}"] for i in range(8)] + [["a"], ["c"], ["c"], ["d", "d"]])
    terms = V.dictionary(docs)
    assert {r.token: (r.df, r.cf) for r in terms.filter("token in ('a', 'd')").collect()} == {"a": (9, 9), "d": (1, 2)}
    kept = V.prune(terms, 12, no_below=2, no_above=0.7).orderBy("term_id").collect()
    assert [(r.term_id, r.token) for r in kept] == [(0, "b"), (1, "c")]
    assert [r.token for r in V.prune(terms, 12, 1, 1.0, keep_n=2).orderBy("term_id").collect()] == ["a", "b"]
    every = V.prune(terms, 12, 1, 1.0, keep_n=None).orderBy("term_id").collect()
    assert [r.term_id for r in every] == list(range(12)) and every[2].token == "c"


@pytest.mark.parametrize("mode", ["tfidf", "count", "onehot"])
def test_vectors_hold_the_weights(spark, planted, mode):
    docs, terms, _, _ = planted
    dense = V.vectors(docs, terms, 121, mode).select("id", F.posexplode(vector_to_array("features")).alias("t", "w")).filter("w <> 0")
    long = V.weigh(docs, terms, 121, mode)
    a = {(r.id, r.t): round(r.w, 9) for r in dense.collect()}
    assert a == {(r.id, r.term_id): round(r.w, 9) for r in long.collect()} and a


def test_rows_have_length_one(planted):
    worst = planted[3].groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).agg(F.max(F.abs(F.col("s") - 1)).alias("m"))
    assert worst.head().m < 1e-9


# --- clusters ------------------------------------------------------------

def test_kmeans_finds_the_plant_and_leaves_empty_documents_out(planted):
    docs, terms, vectors, weights = planted
    model = C.fit_kmeans(vectors, 3, seed=5)
    got = {r.id: r.cluster for r in C.assign(model, vectors).collect()}
    assert len(got) == 121 and got[120] is None
    groups = [{got[i] for i in range(g * 40, g * 40 + 40)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert sum(r.n for r in C.sizes(C.assign(model, vectors)).collect()) == 121
    again = {r.id: r.cluster for r in C.assign(C.fit_kmeans(vectors, 3, seed=5), vectors).collect()}
    assert again == got


def test_elbow_is_half_the_cosine_cost(planted):
    _, _, vectors, weights = planted
    sse = C.elbow(vectors, [3], seed=5).head().sse
    assigned = C.assign(C.fit_kmeans(vectors, 3, seed=5), vectors)
    assert sse == pytest.approx(C.cost(weights, assigned).head().sse, rel=1e-3)
    scores = [r.score for r in C.silhouette(vectors, [2, 3], seed=5).orderBy("k").collect()]
    assert all(-1 <= s <= 1 for s in scores) and scores[1] > scores[0]


def test_assign_nearest_is_what_the_model_says(planted):
    _, _, vectors, weights = planted
    model = C.fit_kmeans(vectors, 3, seed=5)
    got = {r.id: r.cluster for r in C.assign_nearest(weights, C.model_centroids(model), 3).collect()}
    assert got == {r.id: r.cluster for r in C.assign(model, vectors).filter("cluster is not null").collect()}


def test_merges_against_pairwise_means(spark, planted):
    _, _, _, weights = planted
    table = np.zeros((121, 60))
    for r in weights.collect():
        table[r.id, r.term_id] = r.w
    clusters = spark.range(120).select("id", (F.col("id") % 5).cast("int").alias("cluster"))
    first = C.merges(weights, clusters).orderBy("step").collect()
    means = {(a, b): np.mean([1 - table[i] @ table[j] for i in range(a, 120, 5) for j in range(b, 120, 5)])
             for a, b in itertools.combinations(range(5), 2)}
    best = min(means, key=means.get)
    assert (first[0].left, first[0].right) == best and first[0].distance == pytest.approx(means[best], abs=1e-9)
    assert len(first) == 4 and first[-1].size == 120


def test_hierarchical_clusters_cover_all(planted):
    got = C.assign(C.fit_tree(planted[2], 3), planted[2])
    assert got.count() == 121 and got.filter("cluster is null").count() == 1


# --- topics --------------------------------------------------------------

def purity(rows):
    best = {r.id: r.topic_id for r in rows}
    groups = [[best[i] for i in range(g * 40, g * 40 + 40) if i in best] for g in range(3)]
    top = [max(set(g), key=g.count) for g in groups]
    return len(set(top)) == 3 and min(g.count(t) / len(g) for g, t in zip(groups, top)) > 0.9


def test_lda_recovers_the_plant(planted):
    docs, terms, vectors, _ = planted
    model = TP.fit_lda(V.vectors(docs, terms, mode="count"), 3, passes=40, seed=7)
    raw = TP.lda_doc_topic(model, vectors, min_probability=0.0)
    sums = raw.groupBy("id").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 120 and all(abs(r.s - 1) < 1e-6 for r in sums)
    cut = TP.lda_doc_topic(model, vectors)
    assert cut.filter("p > 0 and p < 0.01").count() == 0
    dominant = A.dominant_topic(TP.lda_doc_topic(model, V.vectors(docs, terms, mode="count")), docs)
    assert purity(dominant.collect())
    assert dominant.filter("id = 120").head().topic_id is None
    assert all(abs(r.s - 1) < 1e-6 for r in TP.lda_topic_term(model).groupBy("topic_id").agg(F.sum("w").alias("s")).collect())
    assert TP.lda_score(model, vectors) < 0


def test_lda_update_reads_the_new_batch_only(planted):
    docs, terms, _, _ = planted
    vectors = V.vectors(docs, terms, mode="count")
    old = TP.fit_lda(vectors.filter("id % 2 = 0"), 3, passes=30, seed=7)
    before = old.lam.copy()
    new = TP.update_lda(old, vectors.filter("id % 2 = 1"), passes=10)
    assert (old.lam == before).all() and old.docs == 60 and new.docs == 120 and new.steps == 40
    assert purity(A.dominant_topic(TP.lda_doc_topic(new, vectors), docs).collect())
    same = TP.update_lda(new, vectors.filter("id < 0"))
    assert (same.lam == new.lam).all() and same.docs == 120


def test_lda_steps_and_learned_priors(planted, monkeypatch):
    docs, terms, _, _ = planted
    vectors = V.vectors(docs, terms, mode="count")
    model = TP.fit_lda(vectors, 3, passes=10, chunk=30, seed=7, alpha="auto")
    assert model.steps == 40 and (model.alpha > 0).all() and not np.allclose(model.alpha, 1 / 3)
    assert purity(A.dominant_topic(TP.lda_doc_topic(model, vectors), docs).collect())
    bow = V.bag_of_words(docs, terms)
    assert TP.lda_score(model, vectors, bow, terms, "u_mass") <= 1
    worse = TP.fit_lda(vectors, 3, passes=0, seed=7)
    assert TP.lda_score(worse, vectors) < TP.lda_score(model, vectors)


def test_digamma_and_trigamma():
    assert abs(TP._psi(1.0) + 0.5772156649015329) < 1e-9 and abs(TP._psi1(1.0) - np.pi ** 2 / 6) < 1e-8
    assert abs(TP._psi(0.5) + 1.9635100260214235) < 1e-9


def test_dictionaries_beyond_a_broadcast(planted, monkeypatch):
    docs, terms, vectors, _ = planted
    counts, total = V.dictionary(docs), docs.count()
    want = [tuple(r) for r in V.prune(counts, total, 1, 1.0, 20).orderBy("term_id").collect()]

    def dense(df):
        rows = df.select("id", vector_to_array("features").alias("v"), "empty").collect()
        return {r.id: ([round(x, 9) for x in r.v], r.empty) for r in rows}

    wanted = {mode: dense(V.vectors(docs, terms, mode=mode)) for mode in ("tfidf", "count")}
    monkeypatch.setattr(V, "BROADCAST_ROWS", 5)
    assert [tuple(r) for r in V.prune(counts, total, 1, 1.0, 20).orderBy("term_id").collect()] == want
    for mode, expected in wanted.items():
        assert dense(V.vectors(docs, terms, mode=mode)) == expected


def test_nmf_recovers_the_plant_and_is_not_negative(planted):
    _, _, _, weights = planted
    topics, docs = TP.fit_nmf(weights, 3, 30, iterations=20, seed=2)
    assert topics.filter("w < 0").count() == 0 and docs.filter("p < 0").count() == 0
    assert purity(A.dominant_topic(docs).collect())


def test_nmf_pass_on_packed_documents(spark, planted, monkeypatch):
    _, _, _, weights = planted
    table = np.zeros((121, 30))
    for r in weights.collect():
        table[r.id, r.term_id] = r.w
    monkeypatch.setattr(TP, "PACKED_DOCS", 7)
    h = np.random.default_rng(4).random((3, 30))
    packed = TP._packed(V.doc_arrays(weights).coalesce(1))
    assert packed.count() == -(-120 // 7)
    wtw, wtx = TP._nmf_pass(packed, h)
    w, g = np.zeros((121, 3)), h @ h.T
    for _ in range(50):
        for j in range(3):
            w[:, j] = np.maximum(0.0, w[:, j] + (table @ h[j] - w @ g[:, j]) / g[j, j])
    assert np.allclose(wtw, w.T @ w) and np.allclose(wtx, w.T @ table)
    wtw, wtx = TP._nmf_pass(TP._packed(V.doc_arrays(weights.limit(0))), h)
    assert not wtw.any() and not wtx.any()


def test_lsa_agrees_with_a_dense_svd(planted):
    _, _, vectors, weights = planted
    table = np.zeros((121, 30))
    for r in weights.collect():
        table[r.id, r.term_id] = r.w
    factors = TP.fit_lsa(vectors, 3)
    sigma = [r.sigma for r in factors.select("factor", "sigma").distinct().orderBy("factor").collect()]
    assert np.allclose(sigma, np.linalg.svd(table, compute_uv=False)[:3]) and sigma == sorted(sigma, reverse=True)
    assert TP.lsa_docs(weights, factors, 3).count() == 360
    gram = {(r.term_i, r.term_j): r.v for r in TP.gram(weights, 30).collect()}
    want = table.T @ table
    assert all(abs(v - want[i, j]) < 1e-9 for (i, j), v in gram.items())
    old, new = vectors.filter("id < 60"), vectors.filter("id >= 60")
    merged = TP.update_lsa(TP.fit_lsa(old, 20), new, 3, 30, decay=0.5)  # 20: the rank of the old half
    sigma = [r.sigma for r in merged.select("factor", "sigma").distinct().orderBy("factor").collect()]
    assert np.allclose(sigma, np.linalg.svd(np.vstack([table[:60] * 0.5, table[60:]]), compute_uv=False)[:3])


def test_gram_in_several_tiles(planted, monkeypatch):
    from topicloom.operators import pairs

    _, _, _, weights = planted
    want = {(r.term_i, r.term_j): round(r.v, 9) for r in TP.gram(weights, 30).collect()}
    monkeypatch.setattr(pairs, "TILE", 7)
    assert {(r.term_i, r.term_j): round(r.v, 9) for r in TP.gram(weights, 30).collect()} == want


def test_gram_rows_are_summed_in_their_task(spark, planted, monkeypatch):
    from topicloom.operators import pairs

    _, _, _, weights = planted
    monkeypatch.setattr(pairs, "CELLS", 100)  # three terms a task
    table = np.zeros((121, 30))
    for r in weights.collect():
        table[r.id, r.term_id] = r.w
    old, new = weights.filter("id < 60"), weights.filter("id >= 60")
    found = TP.update_gram(TP.gram_of(old, 30), TP.gram_of(new, 30), 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # pairs are neither shuffled nor grouped
    want = table[:60].T @ table[:60] * 0.25 + table[60:].T @ table[60:]
    got = {(r.term_i, r.term_j): r.v for r in found.collect()}
    assert set(got) == {(i, j) for i in range(30) for j in range(i, 30) if want[i, j]}
    assert all(abs(v - want[i, j]) < 1e-9 for (i, j), v in got.items())
    tables = TP.update_gram(TP.gram(old, 30), TP.gram(new, 30), 0.5)  # stored tables give the same
    assert {(r.term_i, r.term_j): round(r.v, 9) for r in tables.collect()} == {k: round(v, 9) for k, v in got.items()}


def test_gram_takes_the_last_of_equal_terms(spark):
    rows = [(1, 0, 1.0), (1, 0, 3.0), (1, 2, 2.0), (2, 0, 5.0), (None, 2, 1.0), (None, 2, 1.0)]
    got = {(r.term_i, r.term_j): r.v for r in TP.gram(spark.createDataFrame(rows, "id long, term_id long, w double"), 3).collect()}
    assert got == {(0, 0): 34.0, (0, 2): 6.0, (2, 2): 5.0}
    none = spark.createDataFrame([], "id long, term_id long, w double")
    assert TP.gram(none, 0).count() == 0 and TP.gram(none, 3).count() == 0


def test_top_words_compat(spark):
    terms = spark.range(40).select(F.col("id").alias("term_id"), F.concat(F.lit("t"), "id").alias("token"))
    table = spark.range(40).select(F.lit(0).alias("topic_id"), F.col("id").alias("term_id"), (1 / (F.col("id") + 1)).alias("w"))
    assert TP.top_terms(table, terms).count() == 25
    assert TP.top_terms(table, terms, compat=True).count() == 23
    assert A.topic_keywords(table, terms, 3).head().keywords == "t0, t1, t2"


def test_window_counts_against_written_windows(spark):
    rng = random.Random(5)
    docs = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 5, 6, 7, 30, 80)]
    words, window = ["a", "b", "c"], 6
    want = {}
    for doc in docs:
        for at in range(max(len(doc) - window, 0) + 1):
            seen = set(doc[at:at + window])
            for x, y in itertools.product(words, words):
                if x in seen and y in seen:
                    want[words.index(x), words.index(y)] = want.get((words.index(x), words.index(y)), 0) + 1
    got = {(r.a, r.b): r.n for r in CO.window_counts(make(spark, docs), words, window).collect()}
    assert got == want


def test_coherence_prefers_the_plant(spark, planted):
    docs, terms, _, _ = planted
    names = {r.token: r.term_id for r in terms.collect()}
    good = [(0, i + 1, names[f"w0{i}"], f"w0{i}") for i in range(4)]
    mixed = [(1, i + 1, names[f"w{i % 3}{i}"], f"w{i % 3}{i}") for i in range(4)]
    words = spark.createDataFrame(good + mixed, "topic_id int, rank int, term_id long, token string")
    cv = {r.topic_id: r.coherence for r in CO.c_v(docs, words).collect()}
    um = {r.topic_id: r.coherence for r in CO.u_mass(V.bag_of_words(docs, terms), words, 4).collect()}
    assert cv[0] > cv[1] and um[0] > um[1] and um[1] < 0


def test_divergence(spark):
    rows = [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5), (2, 2, 1.0)]
    js = {(r.a, r.b): r.js for r in TP.topic_divergence(spark.createDataFrame(rows, "topic_id int, term_id long, w double"), 3).collect()}
    assert js[0, 1] == pytest.approx(0) and js[0, 2] == pytest.approx(math.log(2))


def test_pipeline_saves_and_loads(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "bravo", "cedar", "delta", "ember", "fjord"]) for _ in range(4)))
                                  for i in range(60)], "id long, body string")
    pipeline = flows.topic_pipeline(k=2, iterations=3)
    stages = pipeline.getStages()
    stages[2]._set(noBelow=5, noAbove=0.9)
    model = pipeline.fit(docs)
    loaded = flows.save_and_load(model, run_path(spark, "model"))
    want = {r.id: [round(x, 6) for x in r.topicDistribution] for r in model.transform(docs).collect()}
    assert {r.id: [round(x, 6) for x in r.topicDistribution] for r in loaded.transform(docs).collect()} == want and want


def test_repeated_fits_and_sweep(spark, planted):
    docs, terms, vectors, _ = planted
    seeds = TP.lda_collection(vectors, 3, [1, 2], passes=2)
    sums = seeds.groupBy("model_id", "topic_id").agg(F.sum("w").alias("s")).collect()
    assert len(sums) == 6 and all(abs(r.s - 1) < 1e-6 for r in sums)
    again = TP.lda_topic_term(TP.refit_lda([vectors.filter("id < 60"), vectors.filter("id >= 60")], 3, passes=2, seed=1))
    assert again.count() == 3 * terms.count()
    sweep = TP.topic_sweep(vectors, docs, terms, [2, 3], passes=2).orderBy("k").collect()
    assert [r.k for r in sweep] == [2, 3] and all(0 <= r.coherence <= 1 for r in sweep)


def test_fitted_ensemble(planted):
    docs, terms, _, _ = planted
    corpus = flows.Corpus(docs, terms, V.vectors(docs, terms, mode="count").persist(), 121)
    topics, distance, clusters, valid, stable = flows.fit_ensemble(corpus, 3, 3, eps=0.3, min_samples=1, min_cores=1, passes=20)
    assert distance.count() == 81 and clusters.count() == 9
    assert all(abs(r.s - 1) < 1e-6 for r in topics.groupBy("topic").agg(F.sum("w").alias("s")).collect())
    labels = {r.label for r in valid.filter("is_valid").collect()}
    assert {r.label for r in stable.select("label").distinct().collect()} <= labels


def test_schema_rows(spark):
    from topicloom.sources import posts as P

    rows = P.schema_rows(spark.range(1).withColumn("t", F.lit(None).cast("string"))).orderBy("position").collect()
    assert [(r.name, r.type, r.mode) for r in rows] == [("id", "bigint", "REQUIRED"), ("t", "string", "NULLABLE")]


def _gathered(index, value, alpha, beta, rounds=50, enough=1e-3):
    """gamma, all documents' cells in one table that is gathered again every round."""
    lengths = np.array([len(i) for i in index])
    row, first = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
    words, weights = beta.T[np.concatenate(list(index))], np.concatenate(list(value))
    gamma, live = np.ones((len(lengths), len(alpha))), np.ones(len(lengths), bool)
    for _ in range(rounds):
        theta = np.exp(TP._mean_log(gamma))
        norm = (theta[row] * words).sum(axis=1) + 1e-100
        fresh = alpha + theta * np.add.reduceat(words * (weights / norm)[:, None], first, axis=0)
        moving = np.abs(fresh - gamma).mean(axis=1) >= enough
        gamma[live], live = fresh[live], live & moving
        if not live.any():
            break
    return gamma


def test_lda_documents_are_solved_from_their_own_cells():
    rng, k, size = np.random.default_rng(3), 15, 5000
    index = pd.Series([np.sort(rng.choice(size, n, replace=False)) for n in rng.integers(1, 400, 400)])
    value = pd.Series([rng.random(len(i)) for i in index])
    beta, alpha = np.exp(TP._mean_log(rng.gamma(0.3, 3.0, (k, size)) + 0.1)), np.full(k, 1 / k)
    gamma, row, terms, weights, norm = TP._infer(index, value, alpha, beta)
    assert np.allclose(gamma, _gathered(index, value, alpha, beta), atol=1e-9)
    theta = np.exp(TP._mean_log(gamma))
    assert np.allclose(norm, (theta[row] * beta.T[terms]).sum(axis=1)) and len(weights) == len(norm)

    def spent(solve):
        began = time.process_time()
        solve(index, value, alpha, beta)
        return time.process_time() - began
    assert min(spent(TP._infer) for _ in range(3)) < 0.75 * min(spent(_gathered) for _ in range(3))


def test_counts_are_added_up_per_batch(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (1, ["b"]), (None, ["a"]), (3, []), (4, None)],
                                 "id long, tokens array<string>").coalesce(1)
    counts = sorted((r.id or 0, r.token, r.n) for r in V.term_counts(docs).collect())
    assert counts == [(0, "a", 1), (1, "a", 2), (1, "b", 1), (1, "b", 2)]
    assert {(r.token, r.df, r.cf) for r in V.dictionary(docs).collect()} == {("a", 2, 3), ("b", 2, 3)}
    grams = {(r.a, r.b, r.n) for r in G.gram_counts(docs).collect()}
    assert grams == {("a", None, 3), ("b", None, 3), ("a", "b", 2), ("b", "a", 1)}
    # the words are not unrolled on the JVM, one row each, before they are counted
    for counted in (V.dictionary(docs), G.gram_counts(docs)):
        assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()


def test_phrase_hits_by_look_up_and_by_join(spark, monkeypatch):
    docs = spark.createDataFrame([(1, list("abcab")), (2, list("ba")), (None, list("ab")), (4, [])], "id long, tokens array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c"), ("z", "a")], "a string, b string")

    def hits():
        return sorted((r.id or 0, r.pos) for r in G.phrase_hits(docs, phrases).collect())
    found = hits()
    assert found == [(0, 0), (1, 0), (1, 1), (1, 3)]
    assert "Generate" not in G.phrase_hits(docs, phrases)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(G, "BROADCAST_ROWS", 2)
    assert hits() == found


def test_lda_documents_are_solved_side_by_side():
    rng = np.random.default_rng(3)
    beta, alpha = rng.random((4, 300)), np.full(4, 0.25)
    lengths = [1, 2, 2, 3, 40, 41, 45, 200, 7, 1]
    index = pd.Series([rng.choice(300, n, replace=False) for n in lengths])
    value = pd.Series([rng.random(n) for n in lengths])
    gamma, row, terms, weights, norm = TP._infer(index, value, alpha, beta)
    for i, n in enumerate(lengths):  # each as if it were alone
        one = TP._infer(index.iloc[[i]], value.iloc[[i]], alpha, beta)
        assert np.allclose(gamma[i], one[0][0], rtol=1e-9) and np.allclose(norm[row == i], one[4], rtol=1e-9)
    # documents of like length share a group, filled up by a third at most
    first = np.cumsum(lengths) - lengths
    groups = TP._groups(np.array(lengths), first, beta.T[terms], weights)
    assert sorted(np.concatenate([g[0] for g in groups]).tolist()) == list(range(len(lengths)))
    assert len(groups) < len(set(lengths)) and all(g[2].shape[1] <= 1.34 * min(lengths[i] for i in g[0]) for g in groups)


def test_fold_in_deals_narrow_rows(spark):
    weights = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 1, 1.0)], "id long, term_id long, w double")
    topics = spark.createDataFrame([(0, 0, 0.7), (0, 1, 0.3), (1, 1, 1.0)], "topic_id int, term_id long, w double")
    plan = E.fold_in(weights, topics, [0, 1], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("RepartitionByExpression [id")


def test_lda_step_is_one_job_and_the_online_update(spark):
    rng, size, k = np.random.default_rng(11), 40, 3
    rows = [(i, np.sort(rng.choice(size, n, replace=False)), rng.random(n) + 0.1) for i, n in enumerate(rng.integers(1, 20, 90).tolist())]
    rows += [rows[0], (None, *rows[1][1:])]  # an id twice, and none
    frame = spark.createDataFrame([(i, Vectors.sparse(size, index.tolist(), value.tolist()), False) for i, index, value in rows],
                                  ["id", "features", "empty"])
    start = [TP._fresh(k, size, seed, "symmetric", None) for seed in (1, 2)]
    models = [TP.replace(model) for model in start]
    TP._run(frame, lambda _: models, 1, 1000, 0.5, 1.0)
    for model, before in zip(models, start, strict=True):
        index, value = (pd.Series([row[j] for row in rows]) for j in (1, 2))
        beta = np.exp(TP._mean_log(before.lam))
        theta = np.exp(TP._mean_log(_gathered(index, value, before.alpha, beta)))
        counts = np.zeros((k, size))
        for line, at, weight in zip(theta, index, value, strict=True):
            counts[:, at] += line[:, None] * beta[:, at] * weight / (line @ beta[:, at])
        assert np.allclose(model.lam, before.eta + counts, rtol=1e-9) and model.steps == 1 and model.docs == len(rows)

    def jobs(passes):
        group = f"lda-{passes}"
        spark.sparkContext.setJobGroup(group, group)
        TP._run(frame, lambda _: [TP.replace(model) for model in start], passes, 30, 0.5, 1.0)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    try:
        assert jobs(3) - jobs(1) == 2 * 4  # 92 documents are 4 steps a pass: no shuffle within a step
    finally:
        spark.sparkContext.setJobGroup("", "")
