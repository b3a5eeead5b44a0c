"""Benchmark decontamination by winnowed k-gram fingerprints.

A text's fingerprints are its k-gram hashes that are the smallest of some window of
``WINDOW_GRAMS`` consecutive ones. Any shared run of ``ITEM_WINDOW`` words holds a whole
window (``K + WINDOW_GRAMS - 1 = ITEM_WINDOW``), whose smallest hash is chosen on either
side alike, so every such run is met. Fingerprints of the documents are joined with
those of the benchmark inside the task; each hit is extended along its diagonal to the
longest equal run of words, and runs of at least ``ITEM_WINDOW`` words count. An item of
fewer words is one window: it has the hash of all its words as its only fingerprint,
looked for among all runs of that length.

Edge cases: null or wordless documents have no hits; wordless items, and items without
an id, are left out; equal item ids count as one item; repeated document rows are
judged each; an empty benchmark leaves every document clean; other columns are kept or
not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from . import blocks as B

ITEM_WINDOW = 13
K = 7
WINDOW_GRAMS = ITEM_WINDOW - K + 1
#: A document is contaminated if hits make up at least 1 / SHARE of its words.
SHARE = 20
#: Benchmark text per index; a larger benchmark is worked through in blocks of this size.
INDEX_BYTES = 32 << 20

_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of ``width``; one value shorter by width - 1."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:len(out) - step], out[step:])
        have += step
    return out


def winnow(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints; ties are all kept."""
    grams = B.gram_hash(words, K)
    if not len(grams):
        return np.empty(0, np.int64), grams
    grams = np.where(rows[K - 1:] == rows[:len(rows) - K + 1], grams, _MOST)
    pad = np.full(WINDOW_GRAMS - 1, _MOST)
    smallest = _extreme(np.concatenate([pad, grams, pad]), WINDOW_GRAMS, np.minimum)
    chosen = _extreme(smallest, WINDOW_GRAMS, np.maximum) == grams
    at = np.flatnonzero(chosen & (grams != _MOST))
    return at, grams[at]


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, row of each, words per row) of lower-cased alphanumeric words."""
    data, bounds = B.text_bytes(column)
    data = B.LOWER[data]
    starts, ends, rows = B.segments(data, bounds, B.ALNUM)
    return B.span_hash(data, starts, ends), rows, np.bincount(rows, minlength=len(bounds) - 1)


@dataclass
class Index:
    """Fingerprints of a block of benchmark items, sorted by hash."""

    items: list[str]
    words: np.ndarray
    begin: np.ndarray  # first word of each item, and one past the last
    hashes: np.ndarray  # fingerprints of items of at least ITEM_WINDOW words
    places: np.ndarray  # their word positions
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # length -> hashes, items
    _bits: np.ndarray | None = None

    def matches(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into grams, word position in the benchmark) of equal fingerprints."""
        if self._bits is None:  # a bit per leading 20 bits of a hash, made once per worker
            self._bits = np.zeros(1 << 20, bool)
            self._bits[self.hashes >> np.uint64(44)] = True
        maybe = np.flatnonzero(self._bits[grams >> np.uint64(44)])
        return _pairs(self.hashes, self.places, grams[maybe], maybe)


def _pairs(keys: np.ndarray, values: np.ndarray, probes: np.ndarray, names: np.ndarray):
    """Join probes with sorted keys: (name of the probe, value) per equal pair."""
    low, high = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
    n = high - low
    at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(names, n), values[at]


def build_index(items: pa.Table) -> Index:
    """Index of a bounded table (item_id, text)."""
    chunks = items.column("text").chunks
    column = pa.concat_arrays(chunks) if chunks else pa.array([], pa.string())
    words, rows, counts = text_words(column)
    begin = np.concatenate([[0], np.cumsum(counts)])
    at, hashes = winnow(words, rows)
    long = counts[rows[at]] >= ITEM_WINDOW
    order = np.argsort(hashes[long], kind="stable")
    made = Index([str(x) for x in items.column("item_id").to_pylist()], words, begin,
                 hashes[long][order], at[long][order])
    for n in sorted(set(counts[(counts > 0) & (counts < ITEM_WINDOW)].tolist())):
        which = np.flatnonzero(counts == n)
        keys = B.gram_hash(words, n)[begin[which]]
        order = np.argsort(keys, kind="stable")
        made.short[n] = keys[order], which[order]
    return made


def find_hits(words: np.ndarray, rows: np.ndarray, counts: np.ndarray,
              index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, item) of each extended hit, in words of the block."""
    first = np.concatenate([[0], np.cumsum(counts)])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, grams = winnow(words, rows)
    probe, place = index.matches(grams)
    if len(probe):
        here = at[probe]
        item = np.searchsorted(index.begin, place, side="right") - 1
        # hits of one document and item on one diagonal are one extension
        seeds = np.unique(np.stack([rows[here], item, here - place]), axis=1)
        runs = [_runs(words, index, int(d), int(i), int(first[r]), int(first[r + 1]))
                for r, i, d in seeds.T]
        found += [(s, e, np.full(len(s), i)) for (s, e), i in zip(runs, seeds[1], strict=True)]
    for n, (keys, which) in index.short.items():
        grams = B.gram_hash(words, n)
        inside = np.flatnonzero(rows[n - 1:] == rows[:len(rows) - n + 1]) if len(grams) else np.empty(0, np.int64)
        start, item = _pairs(keys, which, grams[inside], inside)
        found.append((start, start + n, item))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(words: np.ndarray, index: Index, diagonal: int, item: int, low: int, high: int):
    """Longest equal runs of at least ITEM_WINDOW words on a diagonal."""
    a = max(low, int(index.begin[item]) + diagonal)
    b = min(high, int(index.begin[item + 1]) + diagonal)
    same = np.zeros(b - a + 2, np.int8)
    same[1:-1] = words[a:b] == index.words[a - diagonal:b - diagonal]
    change = np.diff(same)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    enough = end - start >= ITEM_WINDOW
    return a + start[enough], a + end[enough]


def index_blocks(benchmark: DataFrame, size: int = INDEX_BYTES) -> list[DataFrame]:
    """The benchmark in parts of about ``size`` bytes of text, by a hash of the id."""
    kept = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(
        F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = kept.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // size))
    return [kept.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i) for i in range(parts)]


def _send(spark, part: DataFrame) -> Broadcast:
    """Index of one block, to every executor; its size is bounded by INDEX_BYTES."""
    return spark.sparkContext.broadcast(build_index(part.toArrow()))


def find_spans(docs: DataFrame, benchmark: DataFrame, size: int = INDEX_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, spans (first word, end) and items met.

    A benchmark of more than one block adds a pass over the texts for each, written
    between passes so that a task never holds two indexes.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, text string, n_words long, "
              "spans array<struct<start:int,end:int>>, items array<string>")
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"),
                      F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"),
                      F.expr("cast(array() as array<string>)").alias("items"))
    parts = index_blocks(benchmark, size)
    for number, part in enumerate(parts):
        sent = _send(docs.sparkSession, part)

        def work(batch: pa.RecordBatch, sent: Broadcast = sent) -> pa.RecordBatch:
            words, rows, counts = text_words(batch.column(1))
            spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            first = np.concatenate([[0], np.cumsum(counts)])
            for start, end, item in zip(*find_hits(words, rows, counts, sent.value), strict=True):
                row = int(rows[start])
                spans[row].append({"start": int(start - first[row]), "end": int(end - first[row])})
                items[row].append(sent.value.items[item])
            spans, items = ([sorted(x, key=lambda s: (s["start"], s["end"])) for x in spans],
                            [sorted(set(x)) for x in items])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts.astype(np.int64)),
                 pa.array(spans, batch.schema.field(3).type), pa.array(items, batch.schema.field(4).type)],
                names=["doc_id", "text", "n_words", "spans", "items"])
        out = B.map_text(out, work, schema)
        if number + 1 < len(parts):
            out = materialise(out, "benchmark-hits")
    return out


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated, spans); spans are in words."""
    hit = ("aggregate(spans, struct(0 as n, 0 as upto), (a, s) -> struct("
           "a.n + greatest(0, s.end - greatest(s.start, a.upto)) as n, greatest(a.upto, s.end) as upto), a -> a.n)")
    found = find_spans(docs, benchmark).withColumn("n_hit", F.expr(hit).cast("long"))
    return found.select("doc_id", "n_words", "n_hit", "items",
                        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
                        "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without the contaminated ones. One narrow pass per block.

    With more than one block, hits are added up over the passes and the verdict is
    joined back by row.
    """
    parts = index_blocks(benchmark)
    if len(parts) > 1:
        numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
        bad = judge(numbered.select(F.col("_row").alias("doc_id"), "text"), benchmark).filter("contaminated")
        return numbered.join(bad.select(F.col("doc_id").alias("_row")), "_row", "left_anti").drop("_row")
    sent = _send(docs.sparkSession, parts[0])
    place = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, rows, counts = text_words(batch.column(place))
        start, end, _ = find_hits(words, rows, counts, sent.value)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        hits = np.bincount(rows[np.cumsum(change[:-1]) > 0], minlength=batch.num_rows)
        return batch.filter(pa.array(~((hits > 0) & (SHARE * hits >= counts))))
    return B.map_text(docs, work, docs.schema)
