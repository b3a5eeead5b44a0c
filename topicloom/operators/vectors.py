"""Dictionary, bag of words, TF-IDF, and vectors for MLlib."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .corpus import SLICE, coded
from .scale import BROADCAST_ROWS, lookup_join, row_numbers

NO_BELOW = 20
NO_ABOVE = 0.5
KEEP_N = 100_000


def count_docs(docs: DataFrame) -> Column:
    """Number of documents as a scalar subquery."""
    return docs.agg(F.count("*").alias("n")).scalar()


def _batch_counts(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, n, words): how often each word stands in each row of a batch."""
    row, code, words = coded(tokens)
    both, n = np.unique(row * max(len(words), 1) + code, return_counts=True)
    return *np.divmod(both, max(len(words), 1)), n, words


def term_counts(docs: DataFrame) -> DataFrame:
    """(id, token, n): counts per document, made in the task that holds it.

    Nothing is shuffled and later aggregations start from counts instead of tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                row, code, n, words = _batch_counts(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), words.take(pa.array(code)), pa.array(n, pa.int64())],
                    ["id", "token", "n"])

    schema = StructType([docs.schema["id"]]).add("token", StringType()).add("n", LongType())
    return docs.select("id", "tokens").mapInArrow(run, schema)


def dictionary(docs: DataFrame) -> DataFrame:
    """(token, df, cf): document and collection frequency, added up per batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, code, n, words = _batch_counts(batch.column(0))
            df, cf = np.bincount(code, minlength=len(words)), np.bincount(code, n, len(words))
            yield pa.RecordBatch.from_arrays(
                [words, pa.array(df, pa.int64()), pa.array(cf.astype(np.int64))], ["token", "df", "cf"])

    partial = docs.select("tokens").mapInArrow(run, "token string, df long, cf long")
    return partial.groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def prune(terms: DataFrame, num_docs: Column | int, no_below: int = NO_BELOW,
          no_above: float = NO_ABOVE, keep_n: int | None = KEEP_N) -> DataFrame:
    """(term_id, token, df, cf) of the terms kept, ids by falling frequency.

    Kept: df >= no_below, df <= no_above * num_docs, the keep_n most frequent.
    With keep_n the result is bounded by it and may be broadcast up to
    ``BROADCAST_ROWS``; a larger one is numbered without a one-task sort. ``terms``
    is read more than once: hand in a stored dictionary where it is costly.
    """
    total = F.lit(num_docs) if isinstance(num_docs, int) else num_docs
    kept = terms.filter((F.col("df") >= no_below) & (F.col("df") <= total * F.lit(no_above)))
    order = [F.col("df").desc(), F.col("token").asc()]
    if keep_n is None or keep_n > BROADCAST_ROWS:
        numbered = row_numbers(kept, order, "term_id").select("term_id", "token", "df", "cf")
        return numbered if keep_n is None else numbered.filter(F.col("term_id") < keep_n)
    # Cut by frequency classes first: the top-k then sees little more than keep_n
    # rows instead of keep_n rows of every task.
    level = F.floor(F.log2("df") * 64)
    classes = kept.groupBy(level.alias("level")).agg(F.count("*").alias("n"))  # a few thousand rows at most
    above = F.sum("n").over(Window.orderBy(F.col("level").desc()))
    lowest = classes.withColumn("above", above).filter(F.col("above") >= keep_n).agg(F.max("level").alias("l")).scalar()
    top = kept.filter(level >= F.coalesce(lowest, F.lit(-1))).orderBy(*order).limit(keep_n)
    number = F.row_number().over(Window.orderBy(*order)) - 1  # at most keep_n rows
    return top.select(number.cast("long").alias("term_id"), "token", "df", "cf")


def update(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add the counts of more documents to a dictionary."""
    both = old.select("token", "df", "cf").unionByName(new.select("token", "df", "cf"))
    return both.groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def bag_of_words(docs: DataFrame, terms: DataFrame, bounded: bool = True) -> DataFrame:
    """(id, term_id, n). ``bounded`` says that ``terms`` was cut to keep_n rows."""
    counts = term_counts(docs)
    if bounded:
        joined = counts.join(F.broadcast(terms.select("term_id", "token")), "token")
    else:
        joined = lookup_join(counts, terms.select("term_id", "token", "df"), "token", "df")
    return joined.select("id", "term_id", "n")


def one_hot(bow: DataFrame) -> DataFrame:
    """(id, term_id, w) with w = 1 for every term present."""
    return bow.filter(F.col("n") > 0).select("id", "term_id", F.lit(1.0).alias("w"))


def tfidf(bow: DataFrame, terms: DataFrame, num_docs: Column | int, bounded: bool = True) -> DataFrame:
    """(id, term_id, w): n * log2(N / df), scaled to length one per document.

    A document whose terms all stand in every document has no rows.
    """
    total = F.lit(num_docs) if isinstance(num_docs, int) else num_docs
    idf = terms.select("term_id", "df")
    joined = (bow.join(F.broadcast(idf), "term_id") if bounded
              else lookup_join(bow, idf, "term_id", "df"))
    raw = joined.select("id", "term_id", (F.col("n") * F.log2(total / F.col("df"))).alias("raw"))
    raw = raw.filter(F.abs("raw") > 1e-12)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term_id", (F.col("raw") / length).alias("w"))


def weigh(docs: DataFrame, terms: DataFrame, num_docs: Column | int, mode: str = "tfidf",
          bounded: bool = True) -> DataFrame:
    """(id, term_id, w) in mode ``count``, ``onehot`` or ``tfidf``."""
    bow = bag_of_words(docs, terms, bounded)
    if mode == "onehot":
        return one_hot(bow)
    if mode == "tfidf":
        return tfidf(bow, terms, num_docs, bounded)
    return bow.select("id", "term_id", F.col("n").cast("double").alias("w"))


def vectors(docs: DataFrame, terms: DataFrame, num_docs: int | None = None, mode: str = "tfidf") -> DataFrame:
    """(id, features, empty): sparse MLlib vectors by term_id.

    The same weights as :func:`weigh`; ``empty`` marks vectors of length zero.
    A dictionary of up to ``BROADCAST_ROWS`` words is a model, held by the driver and
    sent to each task: no shuffle. With a larger one the weights are joined and
    grouped by document.
    """
    rows = terms.orderBy("term_id").limit(BROADCAST_ROWS + 1).select("token", "df").collect()
    if len(rows) > BROADCAST_ROWS:
        return _grouped_vectors(docs, terms, num_docs, mode)
    words = [row.token for row in rows]
    total = docs.count() if num_docs is None and mode == "tfidf" else num_docs
    model = CountVectorizerModel.from_vocabulary(
        words, inputCol="tokens", outputCol="features", binary=mode == "onehot")
    found = model.transform(docs.select("id", "tokens")).select("id", "features")
    if mode == "tfidf":
        idf = Vectors.dense(np.log2(total / np.array([row.df for row in rows], dtype=float)))
        found = ElementwiseProduct(scalingVec=idf, inputCol="features", outputCol="raw").transform(found)
        found = Normalizer(p=2.0, inputCol="raw", outputCol="scaled").transform(found)
        found = found.select("id", F.col("scaled").alias("features"))
    # words of every document weigh nothing
    weighty = F.exists(F.unwrap_udt("features")["values"], lambda w: w != 0)
    return found.select("id", "features", (~weighty).alias("empty"))


def _grouped_vectors(docs: DataFrame, terms: DataFrame, num_docs: int | None, mode: str) -> DataFrame:
    size = terms.agg(F.max("term_id")).head()[0] + 1
    total = docs.count() if num_docs is None and mode == "tfidf" else num_docs

    @F.udf(VectorUDT())  # Arrow has no type for vectors
    def pack(index, value):
        return Vectors.sparse(size, index or [], value or [])

    arrays = doc_arrays(weigh(docs, terms, total, mode, bounded=False))
    return docs.select("id").join(arrays, "id", "left").select(
        "id", pack("index", "value").alias("features"), F.col("index").isNull().alias("empty"))


def doc_arrays(doc_term: DataFrame) -> DataFrame:
    """(id, index, value): one row per document, for array work inside tasks."""
    pairs = F.sort_array(F.collect_list(F.struct("term_id", "w")))
    rows = doc_term.groupBy("id").agg(pairs.alias("p"))
    return rows.select("id", F.col("p.term_id").alias("index"), F.col("p.w").alias("value"))
