"""Document tables and reports over topics, years and parse states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from .topics import top_terms, topic_share

# Topic numbers of one published model, renumbered by hand.
RELABEL = {0: 2, 1: 6, 2: 1, 3: 5, 4: 3, 5: 4}


def dominant_topic(doc_topic: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(id, topic_id, share): strongest topic, 4 digits; ties to the smaller topic.

    An aggregate, not a sort: rows are reduced before the shuffle. With
    ``docs`` every document has a row; one without any term has no topic.
    """
    # shares are compared at 12 digits, so that ties do not hang on summing order
    best = F.min(F.struct((-F.round("p", 12)).alias("m"), "topic_id", "p"))
    found = doc_topic.groupBy("id").agg(best.alias("b")).filter("b.p > 0")
    found = found.select("id", F.col("b.topic_id").alias("topic_id"), F.round(F.col("b.p"), 4).alias("share"))
    return found if docs is None else docs.select("id").join(found, "id", "left")


def topic_keywords(topic_term: DataFrame, terms: DataFrame, n: int = 10) -> DataFrame:
    """(topic_id, keywords): the top words joined by a comma."""
    words = top_terms(topic_term, terms, n)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "token")))
    return words.groupBy("topic_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["token"]), ", ").alias("keywords"))


def document_topics(dominant: DataFrame, keywords: DataFrame, docs: DataFrame, text: str = "content") -> DataFrame:
    """Final table: id, topic, share, keywords, plain text; joined by id."""
    return (docs.select(F.col("id"), H.plain_text(F.col(text)).alias("Text"))
            .join(dominant, "id").join(F.broadcast(keywords), "topic_id", "left")
            .select(F.col("id").alias("Document_No"), F.col("topic_id").alias("Dominant_Topic"),
                    F.col("share").alias("Topic_Perc_Contrib"), F.col("keywords").alias("Keywords"), "Text"))


def year_index(status: DataFrame) -> DataFrame:
    """(year, total, faulty, existing) from doc_status(id, year, parse_ok)."""
    ok = F.when(F.col("parse_ok"), 1).otherwise(0)
    return status.groupBy("year").agg(
        F.count("*").alias("total"), F.sum(1 - ok).alias("faulty"), F.sum(ok).alias("existing"))


def reconcile(status: DataFrame, existing: DataFrame) -> DataFrame:
    """Total - faulty against the ids that really exist, per year."""
    index = year_index(status).select("year", "total", "faulty")
    found = existing.groupBy("year").agg(F.count("*").alias("existing"))
    joined = index.join(found, "year", "left").fillna(0, ["existing"])
    return joined.withColumn("agrees", F.col("total") - F.col("faulty") == F.col("existing"))


def parse_errors(status: DataFrame, word_counts: DataFrame) -> DataFrame:
    """(year, docs, errors, words, ratio, compat): bad documents per year.

    ``ratio`` is errors / docs of the year. ``compat`` divides by the words
    counted up to that year, as the running report did.
    """
    bad = F.when(F.col("parse_ok"), 0).otherwise(1)
    yearly = status.join(word_counts, "id", "left").groupBy("year").agg(
        F.count("*").alias("docs"), F.sum(bad).alias("errors"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    upto = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per year
    return yearly.withColumn("ratio", F.col("errors") / F.col("docs")).withColumn(
        "compat", F.when(F.sum("words").over(upto) > 0, F.round(F.col("errors") / F.sum("words").over(upto), 4)))


def relabel(doc_topics: DataFrame, mapping: dict[int, int] | None = None, column: str = "topic_id") -> DataFrame:
    """Renumber topics by a mapping; numbers without an entry stay."""
    mapping = RELABEL if mapping is None else mapping
    table = doc_topics.sparkSession.createDataFrame(list(mapping.items()), f"{column} int, _to int")
    joined = doc_topics.join(F.broadcast(table), column, "left")
    return joined.withColumn(column, F.coalesce("_to", column)).select(*doc_topics.columns)


def frequency_labels(doc_topic: DataFrame, doc_length: DataFrame) -> DataFrame:
    """(topic_id, label): 1 is the topic with the largest share of tokens."""
    share = topic_share(doc_topic, doc_length)
    order = Window.orderBy(F.round("share", 12).desc(), "topic_id")  # one row per topic
    return share.select("topic_id", F.row_number().over(order).alias("label"))


def calendar(posts: DataFrame) -> DataFrame:
    """(id, year, month, month_start)."""
    return posts.select("id", F.year("creation_date").alias("year"), F.month("creation_date").alias("month"),
                        F.trunc("creation_date", "month").alias("month_start"))


def post_trend(posts: DataFrame, period: str = "year") -> DataFrame:
    """(period, n): posts per year or month."""
    return posts.groupBy(F.trunc("creation_date", period).alias("period")).agg(F.count("*").alias("n"))


def topic_trend(dated: DataFrame, period: str = "year") -> DataFrame:
    """(period, topic_id, n, share) from (id, topic_id, creation_date)."""
    counts = (dated.filter(F.col("topic_id").isNotNull())
              .groupBy(F.trunc("creation_date", period).alias("period"), "topic_id").agg(F.count("*").alias("n")))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period")))
