"""Filter interaction audit: five document filters in every order, per part of the corpus.

Method. One scan of the texts gives narrow rows: the part, the four text filters A-D
(JVM expressions), two hashes of the whole text and the labels. Filter E (a copy of the
text of a smaller doc_id) needs a duplicate search; a counting Bloom prepass keeps it
off most rows. Every text adds one to ``HASHES`` counters of a table sized from the
row count; the tasks' partial counts are merged by Spark per counter and cut to one bit,
"counted twice or more", in bounded slices. A text with a counter at one is certainly
unique and fails no E. Only the remaining possible repeats are grouped by their hash
(hot keys salted) for the least doc_id of the text; their texts are read a second time
to prove that every hash group holds one text, and groups that do not are decided by
the full text. The five flags of a row make a 5-bit mask; (part, mask, labels) counts
are gathered, and every order, step and sum is an addition over these mask counts.

Contract (``op11``): null texts are empty; words are maximal ``[^\\x20\\x09-\\x0D]+``,
case-sensitive. A: under ``MIN_WORDS`` words; B: ``100 * distinct < 50 * words``;
C: ``100 * [A-Z] > 2 * code points``; D: holds any of ``#$%&*|``; E: the same text as a
row with a smaller doc_id anywhere in the table (a null doc_id is never smaller and
never fails E). A part is a source value, null as the empty string. One row per part,
order of the 120 and step 1-5, zeros included; a document is good or toxic if any
label row of its doc_id says 1. Repeated rows are counted each time. An empty table
gives no rows. Other input columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scale
from ..runtime import materialise, ship

#: Fixed values of the contract.
LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
SYMBOLS = "[#$%&*|]"
#: Counters per row counted, their bounds (the largest is 32 MB of bits, a proven broadcast bound), hashes per text.
COUNTERS_PER_ROW, LEAST_COUNTERS_LOG, MOST_COUNTERS_LOG, HASHES = 8, 12, 28, 3
#: Counters per slice of the merged sketch.
SLICE_LOG = 20


def narrow_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, h1, h2, a, b, c, d, good, toxic): one row per document row, no text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), 0)
    n = F.size(words)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(t).alias("h1"), F.hash(t).alias("h2"), (n < MIN_WORDS).alias("a"),
        (100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n).alias("b"),
        (100 * F.length(F.regexp_replace(t, "[^A-Z]", "")) > UPPER_PERCENT * F.length(t)).alias("c"),
        t.rlike(SYMBOLS).alias("d"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(scale.bounded(marks), "doc_id", "left").select(
        "doc_id", "part", "h1", "h2", "a", "b", "c", "d",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def positions(bits: int) -> list[Column]:
    """Counter positions of a text from its two hashes."""
    mask = (1 << bits) - 1
    h1, h2 = F.col("h1"), F.col("h2").cast("long")
    return [h1.bitwiseAND(mask), F.shiftrightunsigned(h1, 32).bitwiseAND(mask), h2.bitwiseAND(mask)][:HASHES]


def repeat_sketch(narrow: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """Bits of the merged counting sketch: set where a counter reached two."""
    bits = int(min(MOST_COUNTERS_LOG, max(LEAST_COUNTERS_LOG, int(np.ceil(np.log2(max(rows, 1) * COUNTERS_PER_ROW))))))
    slice_log = min(SLICE_LOG, bits)
    counted = narrow.select(F.explode(F.array(*positions(bits))).alias("pos")).groupBy("pos").count() \
        .filter("count >= 2").select(F.shiftright("pos", slice_log).cast("int").alias("slice"), "pos")

    def pack(group: pd.DataFrame) -> pd.DataFrame:  # at most 2**slice_log distinct counters
        flags = np.zeros(1 << slice_log, np.uint8)
        flags[group["pos"].to_numpy() & ((1 << slice_log) - 1)] = 1
        return pd.DataFrame({"slice": [int(group["slice"].iloc[0])], "bits": [np.packbits(flags, bitorder="little").tobytes()]})
    ship(narrow.sparkSession)
    sketch = np.zeros((1 << bits) // 8, np.uint8)
    for r in counted.groupBy("slice").applyInPandas(pack, "slice int, bits binary").collect():  # <= 2**bits / 8 bytes
        at = r["slice"] << (slice_log - 3)
        sketch[at:at + (1 << (slice_log - 3))] = np.frombuffer(r["bits"], np.uint8)
    return sketch, bits


def possible_repeat(spark, sketch: np.ndarray, bits: int):
    """A vectorised column function: may this text occur twice or more?"""
    shared = spark.sparkContext.broadcast(sketch)
    mask = (1 << bits) - 1

    @F.pandas_udf("boolean")
    def possible(h1: pd.Series, h2: pd.Series) -> pd.Series:
        table = shared.value
        a = h1.to_numpy().astype(np.int64)
        b = h2.to_numpy().astype(np.int64)
        found = np.ones(len(a), bool)
        for pos in [a & mask, (a.view(np.uint64) >> np.uint64(32)).astype(np.int64) & mask, b & mask][:HASHES]:
            found &= ((table[pos >> 3] >> (pos & 7)) & 1).astype(bool)
        return pd.Series(found)
    return possible


def with_copies(narrow: DataFrame, documents: DataFrame) -> DataFrame:
    """Narrow rows with ``e``: a smaller doc_id holds the same text."""
    spark = narrow.sparkSession
    sketch, bits = repeat_sketch(narrow, narrow.count())
    possible = possible_repeat(spark, sketch, bits)
    maybe = possible("h1", "h2")
    unique = narrow.filter(~maybe).withColumn("e", F.lit(False))
    candidates = materialise(narrow.filter(maybe).withColumn("hk", F.struct("h1", "h2")), "filter-candidates")
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("h1"),
                             F.hash(t).alias("h2")).filter(possible("h1", "h2")).withColumn("hk", F.struct("h1", "h2"))
    # a hash group with two different texts is decided by the texts themselves
    clashes = materialise(texts.groupBy("hk").agg((F.min("t") != F.max("t")).alias("clash")).filter("clash")
                          .select("hk"), "filter-clashes")
    plain = candidates.join(scale.bounded(clashes), "hk", "left_anti")
    firsts = plain.groupBy("hk").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    decided = scale.lookup_join(plain, firsts, "hk", "n").withColumn(
        "e", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first", "n", "hk")
    by_text = texts.join(scale.bounded(clashes), "hk", "left_semi")
    firsts_by_text = by_text.groupBy("hk", "t").agg(F.min("doc_id").alias("first"))
    later = by_text.join(firsts_by_text, ["hk", "t"]).filter(F.col("doc_id") > F.col("first")) \
        .select("hk", "doc_id").distinct()
    clashed = candidates.join(scale.bounded(clashes), "hk", "left_semi") \
        .join(later.withColumn("e", F.lit(True)), ["hk", "doc_id"], "left") \
        .withColumn("e", F.coalesce("e", F.lit(False))).drop("hk")
    return unique.unionByName(decided).unionByName(clashed)


def _steps() -> list[tuple[str, int, int, int, str]]:
    """(filter_order, step, bit of its filter, bits of the filters before it, letter)."""
    made = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            made.append(("".join(order), step, bit, before, letter))
            before |= bit
    return made


def mask_counts(flagged: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters."""
    mask = sum((F.col(c.lower()).cast("int") * (1 << i) for i, c in enumerate(LETTERS)), F.lit(0))
    return flagged.groupBy("part", mask.alias("mask")).agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"),
        F.sum(F.col("toxic").cast("long")).alias("toxic"))


def audit_counts(masks: DataFrame) -> DataFrame:
    """Every order and step of every part from the mask counts (a few rows per part)."""
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"),
                               F.lit(p).alias("prior"), F.lit(x).alias("letter")) for o, s, b, p, x in _steps()])
    spread = masks.select("*", F.inline(steps))
    m, bit, prior = F.col("mask"), F.col("bit"), F.col("prior")
    fails, before = (m.bitwiseAND(bit) != 0), (m.bitwiseAND(prior) != 0)
    here = fails & ~before

    def total(cond: Column, what: str = "n") -> Column:
        return F.sum(F.when(cond, F.col(what)).otherwise(0)).cast("long")
    per_step = spread.groupBy("part", "filter_order", "step", "letter").agg(
        total(m.bitwiseAND(prior.bitwiseOR(bit)) == 0).alias("kept"), total(here).alias("removed"),
        total(fails & before).alias("redundant"), total(m == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"))
    shapley = per_step.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return per_step.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the module's contract."""
    narrow = materialise(narrow_rows(documents, labels), "filter-flags")
    return audit_counts(mask_counts(with_copies(narrow, documents)))
