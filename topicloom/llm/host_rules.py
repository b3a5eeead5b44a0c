"""Quality rules with a verdict per host.

Rule failures are counted per document, summed per host, and each host's failure
rate is shrunk towards the rate of all hosts with a beta prior whose strength is
estimated from the hosts themselves. The verdict is joined back to the documents.

Edge cases: null and empty texts have no words and fail the rules; documents
without a host form one host of their own; repeated rows count once each; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale
from ..runtime import materialise
from . import blocks as B

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host whose shrunken failure rate is above this is rejected.
MAX_HOST_RATE = 0.5
#: Limits of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 10_000.0

_SYMBOL = B.byte_set(b"#*$%&|<>")
_NOT_NEWLINE = ~B.byte_set(b"\n")


def repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of two or more, has an equal one before it) for keys within their row."""
    with np.errstate(over="ignore"):
        keys = keys ^ B.mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:]] = same
    later[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts behind the rules, for each row of a block."""
    n = len(bounds) - 1
    starts, ends, rows = B.segments(data, bounds, B.NOT_SPACE)
    words = B.span_hash(data, starts, ends)
    repeated = np.zeros(n, np.int64)
    if len(words) >= WINDOW:
        at = np.flatnonzero(rows[WINDOW - 1:] == rows[:len(rows) - WINDOW + 1])
        many, _ = repeats(B.gram_hash(words, WINDOW)[at], rows[at])
        change = np.zeros(len(words) + 1, np.int32)
        np.add.at(change, at[many], 1)
        np.add.at(change, at[many] + WINDOW, -1)
        repeated = np.bincount(rows[np.cumsum(change[:-1]) > 0], minlength=n)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(B.NOT_SPACE[data], out=solid[1:])
    first, last, line_rows = B.segments(data, bounds, _NOT_NEWLINE)
    worded = solid[last] > solid[first]
    first, last, line_rows = first[worded], last[worded], line_rows[worded]
    _, later = repeats(B.span_hash(data, first, last), line_rows)
    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": B.per_row(B.NOT_SPACE[data] & B.LEAD[data], bounds),
        "n_symbols": B.per_row(_SYMBOL[data], bounds),
        "n_dup_lines": np.bincount(line_rows[later], minlength=n),
        "n_repeat_words": repeated,
    }


def rule_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = B.text_bytes(batch.column(2))
        counts = {k: pa.array(v.astype(np.int64)) for k, v in base_counts(data, bounds).items()}
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts.values()],
                                          ["doc_id", "host", *counts])
    kind = dict(docs.dtypes)
    made = B.map_text(
        docs.select("doc_id", F.col("source").cast("string").alias("host"), "text"), work,
        f"doc_id {kind['doc_id']}, host string, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long")
    return made.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_rates(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_ok): failure rates shrunk by a beta prior.

    The prior's mean p is the failure rate of all documents. Its strength comes from
    the spread of the hosts' rates beyond what chance gives: s = p(1-p)/v - 1 with
    v = sum n (r-p)^2 / sum n - p(1-p) H / sum n, kept within fixed limits.
    """
    hosts = counts.groupBy("host").agg(F.count("*").alias("host_docs"),
                                       F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    whole = hosts.agg(F.sum("host_docs").alias("_n"), F.sum("host_failed").alias("_f"), F.count("*").alias("_h"),
                      F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs")).alias("_q"))
    p = F.col("_f") / F.col("_n")
    # sum n (r - p)^2 = sum f^2 / n - p^2 sum n
    spread = F.col("_q") / F.col("_n") - p * p - p * (1 - p) * F.col("_h") / F.col("_n")
    strength = F.when(spread > 0, F.least(F.greatest(p * (1 - p) / spread - 1, F.lit(MIN_STRENGTH)),
                                          F.lit(MAX_STRENGTH))).otherwise(F.lit(MAX_STRENGTH))
    prior = whole.select(p.alias("_p"), strength.alias("_s"))
    rate = (F.col("host_failed") + F.col("_p") * F.col("_s")) / (F.col("host_docs") + F.col("_s"))
    # prior is one row
    return (hosts.join(F.broadcast(prior)).withColumn("host_rate", rate)
            .withColumn("host_ok", F.col("host_rate") <= max_rate).drop("_p", "_s"))


def judge_hosts(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rule counts of each document with its host's figures and the verdict ``kept``.

    The counts are written once and read twice; texts are read once and not shuffled.
    Host figures are broadcast if counted small, else joined with hot hosts spread.
    """
    counts = materialise(rule_counts(docs), "rule-counts")
    hosts = materialise(host_rates(counts, max_rate), "host-rates")
    keyed = counts.withColumn("_host", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")))
    hosts = hosts.withColumn("_host", F.coalesce(F.concat(F.lit("h"), "host"), F.lit(""))).drop("host")
    if hosts.limit(scale.BROADCAST_ROWS + 1).count() <= scale.BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(hosts), "_host")
    else:
        joined = scale.lookup_join(keyed, hosts, "_host", "host_docs")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("_host")
