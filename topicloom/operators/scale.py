"""Helpers that keep ranks, lookups and joins distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

#: A lookup side up to this many rows may be broadcast.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if a count (stopped at the bound) proves it small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """Use all cores on an input of few file splits.

    A large input has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Dense 0-based numbers in a global order without a one-task sort.

    One range shuffle sorts the rows over all tasks. The sorted table is
    checkpointed, which fixes its partitions: the number of a row is its place
    in the partition plus the sizes of the partitions before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition from here to the offsets
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (placed.withColumn("_part", part).withColumn("_place", place)
            .join(F.broadcast(offsets), "_part")
            .select(*df.columns, (F.col("_before") + F.col("_place")).cast("long").alias(name)))


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, weight: str,
                how: str = "inner", salts: int = 32, hot: int = 1000) -> DataFrame:
    """Join facts to a large lookup whose hot keys may hold most of the facts.

    The ``hot`` heaviest lookup keys (a bounded table) are found by ``weight``;
    their facts are spread over ``salts`` tasks and only their lookup rows are
    repeated. All other keys are joined as they are. The salt is a hash of the
    row, so a repeated task sends each row the same way.
    """
    heavy = lookup.orderBy(F.col(weight).desc(), key).limit(hot).select(key, F.lit(salts).alias("_copies"))
    rest = [c for c in facts.columns if c != key] or [key]
    salted = F.when(F.col("_copies").isNotNull(), F.pmod(F.xxhash64(*rest), F.lit(salts)))
    left = (facts.join(F.broadcast(heavy), key, "left")
            .withColumn("_salt", F.coalesce(salted, F.lit(0)).cast("int")).drop("_copies"))
    right = (lookup.join(F.broadcast(heavy), key, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1)))
             .drop("_copies"))
    return left.join(right, [key, "_salt"], how).drop("_salt")
