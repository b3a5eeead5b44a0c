"""End-to-end flows: one call per question a user of the corpus asks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import analysis, clusters, corpus, ensemble, phrases, scale, topics, vectors
from ..runtime import materialise
from ..sources import posts as P
from .stages import DictionaryVectorizer, NgramVectorizer, TextNormalizer


@dataclass
class Corpus:
    """Texts and vectors of a corpus, each written once and reused."""

    docs: DataFrame
    terms: DataFrame
    vectors: DataFrame
    num_docs: int


@dataclass
class TopicRun:
    """Tables of a topic model over a corpus."""

    corpus: Corpus
    topic_term: DataFrame
    doc_topic: DataFrame


def clean_posts(raw: DataFrame) -> DataFrame:
    return raw.select("id", H.clean_post(F.col("title"), F.col("body")).alias("content"))


def html_tokens(raw: DataFrame) -> DataFrame:
    """Web posts to (id, tokens): clean, main content, paragraphs, sentences, tags, normalise.

    A post without main content has no tokens.
    """
    content = F.coalesce(H.main_content(F.col("content")), F.lit(""))
    return corpus.normalise(corpus.tagged_docs(clean_posts(raw).select("id", content.alias("content")), "content"))


def build_corpus(texts: DataFrame, start: int | None = None, end: int | None = None, ngrams: str | None = "b",
                 limit: int | None = None, mode: str = "tfidf") -> Corpus:
    """Years start..end of plain-text posts as normalised documents and vectors.

    ``limit`` takes that many posts of each year.
    """
    chosen = P.in_years(texts, start, end)
    if limit is not None:
        chosen = corpus.first_per_year(chosen, limit)
    docs = materialise(corpus.normalised_docs(scale.spread(chosen)), "docs")
    if ngrams:
        docs = materialise(phrases.ngram_docs(docs, ngrams), "ngrams")
    total = docs.count()
    counts = materialise(vectors.dictionary(docs), "dictionary")
    terms = materialise(vectors.prune(counts, total), "terms")
    return Corpus(docs, terms, materialise(vectors.vectors(docs, terms, total, mode), "vectors"), total)


def fit_topics(corpus_: Corpus, k: int = 6, **options) -> TopicRun:
    model = topics.fit_lda(corpus_.vectors, k, **options)
    return TopicRun(corpus_, topics.lda_topic_term(model), topics.lda_doc_topic(model, corpus_.vectors))


def fit_ensemble(corpus_: Corpus, k: int, models: int, eps: float | None = 0.1, min_samples: int | None = None,
                 min_cores: int | None = None, seed: int = 1, **options):
    """Fit the models, compare their topics, keep the stable ones.

    Returns (topics, distances, clusters, valid, stable). ``eps=None`` takes
    the largest distance, which joins all that any chain of topics connects.
    """
    stacked = topics.lda_collection(corpus_.vectors, k, [seed + i for i in range(models)], **options)
    table = materialise(ensemble.stack(stacked, k), "ensemble")
    distance = materialise(ensemble.topic_distance(table, k * models), "distance")
    eps = ensemble.distance_summary(distance).head().most if eps is None else eps
    found = ensemble.recluster(table, distance, k * models, eps,
                               int(models / 2) if min_samples is None else min_samples,
                               ensemble.default_min_cores(models) if min_cores is None else min_cores)
    return table, distance, *found


def cluster_posts(corpus_: Corpus, k: int = clusters.K, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) of every post, and the top words of each cluster."""
    doc_cluster = materialise(clusters.assign(clusters.fit_kmeans(corpus_.vectors, k, seed), corpus_.vectors), "clusters")
    weights = vectors.weigh(corpus_.docs, corpus_.terms, corpus_.num_docs)
    return doc_cluster, clusters.cluster_words(weights, doc_cluster, corpus_.terms)


def analyse(run: TopicRun, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document table with dates, topics numbered by size; and its yearly trend."""
    length = vectors.bag_of_words(run.corpus.docs, run.corpus.terms).groupBy("id").agg(F.sum("n").alias("n"))
    labels = F.broadcast(analysis.frequency_labels(run.doc_topic, length))  # one row per topic

    def renumber(df: DataFrame) -> DataFrame:
        named = df.join(labels, "topic_id", "left").withColumn("topic_id", F.col("label"))
        return named.drop("label")

    dominant = renumber(analysis.dominant_topic(run.doc_topic, run.corpus.docs))
    keywords = renumber(analysis.topic_keywords(run.topic_term, run.corpus.terms))
    final = analysis.document_topics(dominant, keywords, clean_posts(raw))
    dated = corpus.with_dates(final.withColumnRenamed("Document_No", "id"), raw)
    trend = analysis.topic_trend(dated.withColumnRenamed("Dominant_Topic", "topic_id"))
    return dated.withColumnRenamed("id", "Document_No").withColumnRenamed("creation_date", "Datetime"), trend


def topic_pipeline(k: int = 6, seed: int = 1, iterations: int = 20) -> Pipeline:
    """Text to topics as one MLlib pipeline: normalise, phrases, vectors, LDA."""
    return Pipeline(stages=[TextNormalizer(), NgramVectorizer(), DictionaryVectorizer(),
                            LDA(k=k, seed=seed, maxIter=iterations, optimizer="online")])


def save_and_load(model: PipelineModel, path: str) -> PipelineModel:
    model.write().save(path)
    return PipelineModel.load(path)
