"""Shared stages of the catalogue: the normalised corpus and fixed model tables.

Normalised documents, the dictionary and the bag of words feed most queries.
Each is written once per session and folder and read back, as a production run
would keep its token table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, scale, vectors
from ..runtime import materialise, on_clean_up
from ..sources import posts as P

TOPICS = 6
MODELS = 4
CLUSTERS = 7

_written: dict[tuple[str, str, str], DataFrame] = {}
on_clean_up(_written.clear)


def once(spark: SparkSession, directory: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, directory, name)
    if key not in _written:
        _written[key] = materialise(make(), name)
    return _written[key]


def texts(spark: SparkSession, directory: str) -> DataFrame:
    return scale.spread(P.posts(spark, directory))


def pages(spark: SparkSession, directory: str) -> DataFrame:
    return scale.spread(P.html_posts(spark, directory))


def docs(spark: SparkSession, directory: str) -> DataFrame:
    """(id, tokens): normalised posts, in all languages as the rules are applied to all."""
    return once(spark, directory, "docs", lambda: corpus.normalised_docs(texts(spark, directory)))


def dictionary(spark: SparkSession, directory: str) -> DataFrame:
    """(token, df, cf) of every token."""
    return once(spark, directory, "dictionary", lambda: vectors.dictionary(docs(spark, directory)))


def terms(spark: SparkSession, directory: str) -> DataFrame:
    """Pruned dictionary."""
    return once(spark, directory, "terms", lambda: vectors.prune(
        dictionary(spark, directory), vectors.count_docs(docs(spark, directory))))


def bow(spark: SparkSession, directory: str) -> DataFrame:
    return once(spark, directory, "bow",
                lambda: vectors.bag_of_words(docs(spark, directory), terms(spark, directory)))


def tfidf(spark: SparkSession, directory: str) -> DataFrame:
    return vectors.tfidf(bow(spark, directory), terms(spark, directory), vectors.count_docs(docs(spark, directory)))


def model_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """(id, features, empty): TF-IDF vectors for MLlib."""
    return once(spark, directory, "vectors",
                lambda: vectors.vectors(docs(spark, directory), terms(spark, directory)))


def size(spark: SparkSession, directory: str) -> int:
    return terms(spark, directory).count()


# --- deterministic stand-ins for fitted models, rebuilt by the SQL oracles ---

def fixed_doc_topic(bag: DataFrame) -> DataFrame:
    """p(doc, t) proportional to 1 + tokens of the document with term_id % 6 = t."""
    counts = [F.sum(F.when(F.col("term_id") % TOPICS == t, F.col("n")).otherwise(0)) for t in range(TOPICS)]
    wide = bag.groupBy("id").agg(F.sum("n").alias("all"), *[c.alias(f"n{t}") for t, c in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n{t}").alias("n")) for t in range(TOPICS)])
    return wide.select("id", "all", F.explode(rows).alias("x")).select(
        "id", F.col("x.t").alias("topic_id"), ((1 + F.col("x.n")) / (TOPICS + F.col("all"))).alias("p"))


def _shares(bag: DataFrame, key: Column, name: str) -> DataFrame:
    sums = bag.groupBy(key.alias(name), "term_id").agg(F.sum("n").alias("n"))
    totals = sums.groupBy(name).agg(F.sum("n").alias("t"))
    return sums.join(F.broadcast(totals), name).select(name, "term_id", (F.col("n") / F.col("t")).alias("w"))


def fixed_topic_term(bag: DataFrame) -> DataFrame:
    """Topic t has the term shares of the documents with id % 6 = t."""
    return _shares(bag, (F.col("id") % TOPICS).cast("int"), "topic_id")


def fixed_ensemble(bag: DataFrame) -> DataFrame:
    """24 topics: model floor(id / 6) % 4, topic id % 6."""
    model = F.floor(F.col("id") / TOPICS) % MODELS
    return _shares(bag, (model * TOPICS + F.col("id") % TOPICS).cast("long"), "topic")


def fixed_clusters(texts: DataFrame) -> DataFrame:
    return texts.select("id", (F.col("id") % CLUSTERS).cast("int").alias("cluster"))


def doc_length(bag: DataFrame) -> DataFrame:
    return bag.groupBy("id").agg(F.sum("n").alias("n"))


def doc_status(raw: DataFrame) -> DataFrame:
    """(id, year, parse_ok): every 50th post counts as unparseable."""
    return raw.select("id", F.year("creation_date").alias("year"), (F.col("id") % 50 != 0).alias("parse_ok"))
