"""Table maintenance: append, column changes, batches, round trips, run numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import row_numbers

# Fixed value: line of a training log with its two figures.
CONVERGENCE_LINE = r"(-*\d+\.\d+) per-word .* (\d+\.\d+) perplexity"


def append(df: DataFrame, path: str) -> DataFrame:
    """Create the table if missing, append the rows, return the whole table."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dates_to_text(df: DataFrame) -> DataFrame:
    """Cast every column with ``date`` in its name to string."""
    return df.select(*[F.col(c).cast("string").alias(c) if "date" in c else F.col(c) for c in df.columns])


def add_column(df: DataFrame, name: str, type_: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(type_))


def update_column(df: DataFrame, updates: DataFrame, column: str, key: str = "id",
                  order: str | None = None) -> DataFrame:
    """Set ``column`` from ``updates(key, column)``, also to null.

    Several updates of one key: the one with the highest ``order`` wins, as the
    last statement would; without an order column, the highest value.
    """
    ranking = F.struct(F.col(order or column).alias("o"), F.col(column).alias("v"))
    latest = updates.groupBy(key).agg(F.max(ranking)["v"].alias("_new"), F.lit(True).alias("_hit"))
    changed = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))
    return (df.join(latest, key, "left").withColumn(column, changed)
            .select(*df.columns))


def batch_numbers(df: DataFrame, key: str = "id", size: int = 50, offset: int = 0,
                  limit: int | None = None) -> DataFrame:
    """Fixed-size batches in key order, as one column instead of paged reads."""
    numbered = row_numbers(df, [F.col(key)], "row_no").filter(F.col("row_no") >= offset)
    if limit is not None:
        numbered = numbered.filter(F.col("row_no") < offset + limit)
    return numbered.withColumn("batch", F.floor((F.col("row_no") - offset) / size).cast("long"))


def roundtrip_csv(df: DataFrame, path: str) -> DataFrame:
    """Write as CSV and read back under the same schema."""
    df.write.csv(path, header=True, escape='"', quoteAll=True)
    return df.sparkSession.read.csv(path, header=True, escape='"', schema=df.schema)


def write_run(df: DataFrame, path: str, run: int) -> None:
    """Overwrite one run of a table kept by run number; other runs stay."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}")


def next_run(runs: DataFrame) -> DataFrame:
    """Next free number of a runs table."""
    return runs.agg((F.coalesce(F.max("run"), F.lit(0)) + 1).alias("run"))


def next_run_number(spark: SparkSession, path: str) -> int:
    """Next free run number under a folder written by :func:`write_run`."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 1
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    taken = [int(m.group(1)) for name in names if (m := re.fullmatch(r"run=(\d+)", name))]
    return max(taken, default=0) + 1


def convergence(lines: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """(iteration, likelihood, perplexity) of the matching log lines, 10 apart.

    ``order`` puts the lines in writing order.
    """
    found = lines.filter(F.col(text).rlike(CONVERGENCE_LINE))
    numbered = row_numbers(found, order, "_line")
    return numbered.select(
        (F.col("_line") * 10).alias("iteration"),
        F.regexp_extract(text, CONVERGENCE_LINE, 1).cast("double").alias("likelihood"),
        F.regexp_extract(text, CONVERGENCE_LINE, 2).cast("double").alias("perplexity"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files in order of file name, then position in the file."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    return convergence(lines, "value", [F.col("file"), F.col("block"), F.col("at")])
