"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Boosting goes round the features; each
step fits a shallow tree on one feature's bins to the residuals and adds it, shrunk, to
that feature's look-up table. Then the pairs of features whose tables of residuals
explain most get tables of their own, fitted the same way. A text's score is the
logistic of the sum of its bins' entries.

The fit uses a bounded sample of labelled rows (``SAMPLE``), chosen by hash of the id;
only their bins reach the driver. Scoring is one narrow pass over all texts.

Edge cases: null and empty texts are scored by their (zero) features; labels without a
document, or null, are left out; a document labelled twice counts twice; if the sample
has one class or none, the score is its smoothed share; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .host_rules import base_counts, repeats

#: Bound of the labelled sample.
SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIRS, PAIR_ROUNDS = 120, 8, 40
RATE, LEAST_HESSIAN = 0.15, 1.0
PREDICT = 0.3

_UPPER, _LOWER = B.byte_set(bytes(range(65, 91))), B.byte_set(bytes(range(97, 123)))
_DIGIT, _STOP = B.byte_set(b"0123456789"), B.byte_set(b".,;:!?")
_OTHER = B.byte_set(b"\"'()[]{}<>|/\\@#$%^&*_=+~`")
_NEWLINE = B.byte_set(b"\n")

FEATURES = ("log_words", "word_length", "symbols", "upper", "capital_words", "digits", "stops", "marks", "bars",
            "shouts", "dup_lines", "repeat_words", "distinct_words", "doubled_words", "line_words", "short_words",
            "long_words", "marked_words", "sentence_words", "non_ascii", "top_word")


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x FEATURES of a block of texts."""
    n = len(bounds) - 1
    base = base_counts(data, bounds)
    starts, ends, rows = B.segments(data, bounds, B.NOT_SPACE)
    hashes = B.span_hash(data, starts, ends)
    words = np.maximum(base["n_words"], 1).astype(float)
    chars = np.maximum(base["word_chars"], 1).astype(float)
    lines = B.per_row(_NEWLINE[data], bounds) + 1.0
    many, later = repeats(hashes, rows)
    doubled = np.zeros(len(hashes), bool)
    if len(hashes):
        doubled[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    length = ends - starts

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(rows[mask], minlength=n).astype(float)

    def letters(table: np.ndarray) -> np.ndarray:
        return B.per_row(table[data], bounds).astype(float)
    last, first = data[ends - 1], data[starts]
    # the most frequent word's share
    with np.errstate(over="ignore"):
        _, at, times = np.unique(hashes ^ B.mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, rows[at], times)
    return np.column_stack([
        np.log1p(base["n_words"]), base["word_chars"] / words, base["n_symbols"] / words, letters(_UPPER) / chars,
        count(_UPPER[first]) / words, letters(_DIGIT) / chars, letters(_STOP) / words, letters(_OTHER) / words,
        B.per_row(data == 124, bounds) / words, B.per_row(data == 33, bounds) / words, base["n_dup_lines"] / lines,
        base["n_repeat_words"] / words, count(~later) / words, count(doubled) / words, words / lines,
        count(length <= 2) / words, count(length >= 12) / words, count(_OTHER[last] | _OTHER[first]) / words,
        words / (count(_STOP[last]) + 1), B.per_row(data >= 128, bounds) / chars, top / words])


@dataclass
class Model:
    """Bin edges and look-up tables."""

    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, values[:, f], side="right") for f, e in enumerate(self.edges)])

    def score(self, values: np.ndarray) -> np.ndarray:
        """Logistic of the sum of table entries, one gather and addition per table."""
        total = np.full(len(values), self.start)
        if self.tables:
            bins = self.bins(values)
            for f, table in enumerate(self.tables):
                total += table[bins[:, f]]
            for f, g, table in self.pairs:
                total += table[_coarse(bins[:, f]), _coarse(bins[:, g])]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def _split(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of the best cut of ordered bins."""
    g, h = np.cumsum(gradient), np.cumsum(hessian)
    left, right = h[:-1], h[-1] - h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g[:-1] ** 2 / left + (g[-1] - g[:-1]) ** 2 / right - g[-1] ** 2 / h[-1]
    gain[(left < LEAST_HESSIAN) | (right < LEAST_HESSIAN) | ~np.isfinite(gain)] = 0
    cut = int(gain.argmax()) if len(gain) else 0
    return (float(gain[cut]) if len(gain) else 0.0), cut + 1


def _leaf(gradient: np.ndarray, hessian: np.ndarray) -> float:
    return float(gradient.sum() / (hessian.sum() + 1.0))


def shallow_tree(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with up to four leaves: one cut, then one on either side."""
    values = np.zeros(len(gradient))
    gain, cut = _split(gradient, hessian)
    parts = [(0, cut), (cut, len(gradient))] if gain > 0 else [(0, len(gradient))]
    for low, high in parts:
        gain, cut = _split(gradient[low:high], hessian[low:high])
        for a, b in [(low, low + cut), (low + cut, high)] if gain > 0 else [(low, high)]:
            values[a:b] = _leaf(gradient[a:b], hessian[a:b])
    return values


def shallow_pair_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of a tree that cuts one of two features, then the other on either side."""
    best = 0.0, np.zeros_like(gradient)
    for turned in (False, True):
        g, h = (gradient.T, hessian.T) if turned else (gradient, hessian)
        first, cut = _split(g.sum(axis=1), h.sum(axis=1))
        values, gain = np.zeros_like(g), first
        for low, high in [(0, cut), (cut, len(g))] if first > 0 else [(0, len(g))]:
            gs, hs = g[low:high].sum(axis=0), h[low:high].sum(axis=0)
            more, at = _split(gs, hs)
            gain += more
            for a, b in [(0, at), (at, len(gs))] if more > 0 else [(0, len(gs))]:
                values[low:high, a:b] = _leaf(gs[a:b], hs[a:b])
        if gain > best[0]:
            best = gain, values.T if turned else values
    return best


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """Cyclic boosting over a bounded sample."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < labels.sum() < len(labels):
        return model
    for f in range(values.shape[1]):
        model.edges.append(np.unique(np.quantile(values[:, f], np.arange(1, BINS) / BINS)))
        model.tables.append(np.zeros(BINS))
    bins = model.bins(values)
    total = np.full(len(labels), model.start)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)
    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = residuals()
            step = RATE * shallow_tree(np.bincount(bins[:, f], g, BINS), np.bincount(bins[:, f], h, BINS))
            table += step
            total += step[bins[:, f]]
    coarse = _coarse(bins)

    def pair_sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        at, (r, w) = coarse[:, f] * PAIR_BINS + coarse[:, g], residuals()
        return (np.bincount(at, r, PAIR_BINS ** 2).reshape(PAIR_BINS, -1),
                np.bincount(at, w, PAIR_BINS ** 2).reshape(PAIR_BINS, -1))
    ranked = sorted(((shallow_pair_tree(*pair_sums(f, g))[0], f, g) for f in range(len(model.tables)) for g in range(f)),
                    key=lambda x: (-x[0], x[1:]))
    model.pairs = [(f, g, np.zeros((PAIR_BINS, PAIR_BINS))) for _, f, g in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for f, g, table in model.pairs:
            step = RATE * shallow_pair_tree(*pair_sums(f, g))[1]
            table += step
            total += step[coarse[:, f], coarse[:, g]]
    return model


def _scored(docs: DataFrame, make, schema: str) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return make(batch, features(*B.text_bytes(batch.column(1))))
    return B.map_text(docs, work, schema)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` labelled rows (doc_id, label)."""
    labels = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    share = sample / max(labels.count(), 1)
    if share < 1:  # ids whose hash falls in the first part of its range
        labels = labels.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # a few standard deviations above ``sample`` rows at most, whatever the number of labels
    chosen = docs.join(F.broadcast(labels.select("doc_id", F.col("label").cast("int").alias("label"))), "doc_id") \
        .select("doc_id", "text", "label")

    def make(batch: pa.RecordBatch, values: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(values.ravel())
        at = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(at, flat)],
                                          ["doc_id", "label", "features"])
    kind = dict(docs.dtypes)["doc_id"]
    rows = _scored(chosen, make, f"doc_id {kind}, label int, features array<double>").toArrow().to_pandas()
    if rows.empty:
        return Model(0.0)
    rows = rows.sort_values(["doc_id", "label"])  # the order of rows must not change the fit
    return fit(np.stack(rows["features"].to_numpy()), rows["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model, threshold: float = PREDICT) -> DataFrame:
    """(doc_id, score, predicted) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch, values: np.ndarray) -> pa.RecordBatch:
        found = sent.value.score(values)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
            ["doc_id", "score", "predicted"])
    kind = dict(docs.dtypes)["doc_id"]
    return _scored(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int")
