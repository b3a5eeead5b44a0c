"""Post tables, scans, filters and paged reads."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wordlists import KEYWORDS


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _dated(key: Column) -> Column:
    # the tables carry no date: spread ids over 2012-01-01 .. 2021-12-31
    return F.date_add(F.lit("2012-01-01").cast("date"), ((key * 37) % 3653).cast("int"))


def posts(spark: SparkSession, directory: str) -> DataFrame:
    """Text posts: id, title, body, lang, source, creation_date."""
    docs = table(spark, directory, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        "lang",
        "source",
        _dated(F.col("doc_id")).alias("creation_date"),
    )


def html_posts(spark: SparkSession, directory: str) -> DataFrame:
    """Web posts: id, title, body (HTML), creation_date."""
    pages = table(spark, directory, "pages")
    return pages.select(
        F.col("page_id").alias("id"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("body"),
        _dated(F.col("page_id")).alias("creation_date"),
    )


def answers(spark: SparkSession, directory: str) -> DataFrame:
    """Answer posts: the assistant turns of the conversations."""
    turns = table(spark, directory, "conversations")
    return turns.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("id"), "turn", F.col("text").alias("body"))


def schema_rows(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, mode."""
    rows = [
        (i, field.name, field.dataType.simpleString(), "NULLABLE" if field.nullable else "REQUIRED")
        for i, field in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, mode string")


def newest(df: DataFrame, n: int = 100) -> DataFrame:
    """The n newest posts; ties go to the smaller id (top-k, no global sort)."""
    return df.orderBy(F.col("creation_date").desc(), "id").limit(n)


def keyword_filter(df: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Posts that name one of the keywords as a whole word, any case."""
    alternation = "|".join(re.sub(r"([^\w\s])", r"\\\1", word) for word in keywords)
    pattern = rf"(?i)(^|[^\p{{L}}\p{{N}}_])({alternation})([^\p{{L}}\p{{N}}_]|$)"
    return df.filter(F.col("title").rlike(pattern) | F.col("body").rlike(pattern))


def in_years(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Posts of the years start..end; ``None`` leaves a side open.

    A range on the date column itself, which a scan can prune by if the table stores it.
    """
    if start is not None:
        df = df.filter(F.col("creation_date") >= F.lit(f"{start}-01-01").cast("date"))
    if end is not None:
        df = df.filter(F.col("creation_date") < F.lit(f"{end + 1}-01-01").cast("date"))
    return df


def read_page(df: DataFrame, columns: Sequence[str] | None = None, where: str | None = None,
              like: str | None = None, order: Sequence[str] = (), descending: bool = True,
              limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Select list, case-insensitive LIKE, order, limit and offset in one read."""
    if where is not None:
        df = df.filter(F.col(where).ilike(like))
    if order:
        df = df.orderBy(*[F.col(name).desc() if descending else F.col(name).asc() for name in order])
    if offset is not None:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))
