"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton holds a bounded sample of whole labelled texts. A text is
parsed greedily into the longest phrases that occur in the sample; the fewer phrases,
the closer the language. The phrase count, times the bits that point into the sample,
over the text's length is an estimate of its cross entropy; the least one wins.

Texts are lower-cased, all that is no letter becomes one space, and each text is parsed
in pieces of ``PIECE`` bytes so that many pieces run side by side.

Edge cases: null texts and texts without a letter are ``und`` with score 0; ties go to
the language that sorts first; with no learnt language every text is ``und``; repeated
rows are judged each; other columns are kept or not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

#: Bound of the labelled sample per language: whole texts of at most SLOTS documents, taken
#: in hash order while their total stays within SAMPLE_CHARS; no text is ever cut.
SLOTS, SAMPLE_CHARS = 192, 65_536
PIECE = 256
UNKNOWN = "und"
#: Bytes that can be part of a letter after lower-casing.
_LETTER = B.byte_set(b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))


def labelled_sample(docs: DataFrame, slots: int = SLOTS, size: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, texts): a bounded sample of whole texts per language, the same whatever the order of rows.

    The ids of a language are dealt into slots by hash and the smallest hash of each
    slot is taken, so only slots x languages rows meet in an aggregation. Of those, whole
    texts are taken in hash order as long as their total length stays within ``size``;
    a text longer than ``size`` is never taken, and no text is cut.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & F.col("text").rlike("\\p{L}") & (F.length("text") <= size))
    key = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = rows.groupBy(F.col("lang").alias("_lang"), F.pmod(key, F.lit(slots)).alias("_slot")) \
        .agg(F.min(key).alias("_key")).select("_lang", "_key")
    picked = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("_lang")) & (key == F.col("_key")))
    # repeated ids leave one text; at most ``slots`` rows a language from here on
    one = picked.groupBy("lang", "_key").agg(F.min("text").alias("_text"))
    total = F.sum(F.length("_text")).over(Window.partitionBy("lang").orderBy("_key"))
    kept = one.withColumn("_total", total).filter(F.col("_total") <= size)
    return kept.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("_key", "_text"))).alias("_rows")) \
        .select("lang", F.transform("_rows", lambda r: r["_text"]).alias("excerpts"))


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) in lower case with one space (0) for any run of other bytes."""
    data, bounds = B.text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    letter = _LETTER[data]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first other byte after a letter stays as the space
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    kept[first] = letter[first]
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    return np.where(letter, data, 0)[kept], place[bounds]


@dataclass
class Automaton:
    """Suffix automaton as a dense table: state x symbol -> state, -1 where none leads on."""

    symbol: np.ndarray  # byte -> column
    table: np.ndarray
    size: int  # sample length

    @classmethod
    def of(cls, sample: bytes) -> Automaton:
        """Automaton of all substrings of a bounded sample."""
        links, lengths, nexts, last = [-1], [0], [{}], 0
        for symbol in sample:
            here = len(nexts)
            links.append(0)
            lengths.append(lengths[last] + 1)
            nexts.append({})
            at = last
            while at >= 0 and symbol not in nexts[at]:
                nexts[at][symbol] = here
                at = links[at]
            if at >= 0:
                other = nexts[at][symbol]
                if lengths[at] + 1 == lengths[other]:
                    links[here] = other
                else:
                    copy = len(nexts)
                    links.append(links[other])
                    lengths.append(lengths[at] + 1)
                    nexts.append(dict(nexts[other]))
                    while at >= 0 and nexts[at].get(symbol) == other:
                        nexts[at][symbol] = copy
                        at = links[at]
                    links[other] = links[here] = copy
            last = here
        used = sorted(set(sample))
        symbols = np.full(256, len(used), np.int64)  # bytes not in the sample share a column
        symbols[used] = np.arange(len(used))
        table = np.full((len(nexts) + 1, len(used) + 1), -1, np.int32)  # last row: behind an unknown byte
        for state, row in enumerate(nexts):
            if row:
                table[state, symbols[list(row)]] = list(row.values())
        return cls(symbols, table, len(sample))

    def phrases(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each row, pieces of PIECE bytes parsed side by side."""
        start, length, row = B.lanes(bounds, PIECE)
        if not len(start):
            return np.zeros(len(bounds) - 1, np.int64)
        codes, width = self.symbol[data], self.table.shape[1]
        flat = self.table.ravel()
        dead = len(self.table) - 1
        restart = np.where(self.table[0] < 0, dead, self.table[0]).astype(np.int32)
        state = np.full(len(start), dead, np.int64)
        counts = np.zeros(len(start), np.int32)
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        for step, n in enumerate(active):
            code = codes[start[:n] + step]
            after = flat[state[:n] * width + code]
            stuck = after < 0
            counts[:n] += stuck
            state[:n] = np.where(stuck, restart[code], after)
        return np.bincount(row, weights=counts, minlength=len(bounds) - 1).astype(np.int64)


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Sample text per language: whole texts, at most SAMPLE_CHARS characters each."""
    found = labelled_sample(docs).collect()  # one bounded row per language
    samples = {}
    for row in sorted(found, key=lambda r: r["lang"]):
        data, bounds = normalise(pa.array(row["excerpts"], pa.string()))
        samples[row["lang"]] = b"\x00".join(data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    return samples


_built: dict[int, tuple[dict[str, bytes], list[Automaton]]] = {}


def _automata(samples: dict[str, bytes]) -> list[Automaton]:
    """Automata of the samples, built once per worker."""
    key = hash(tuple(samples.items()))
    if key not in _built:
        _built.clear()
        _built[key] = samples, [Automaton.of(s) for s in samples.values()]
    return _built[key][1]


def predict_block(column: pa.Array, samples: dict[str, bytes]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; the score is the lead over the second, 0 to 1."""
    data, bounds = normalise(column)
    n, names = len(column), list(samples)
    lettered = np.diff(bounds) > 0
    # non-ASCII bytes need not be letters: ask for those without an ASCII one
    plain = B.per_row((data > 96) & (data < 123), bounds) > 0
    for i in np.flatnonzero(lettered & ~plain):
        lettered[i] = any(c.isalpha() for c in column[int(i)].as_py())
    if not names:
        return [UNKNOWN] * n, np.zeros(n)
    size = np.maximum(np.diff(bounds), 1)
    bits = np.stack([a.phrases(data, bounds) * np.log2(max(a.size, 2)) / size for a in _automata(samples)])
    best = bits.argmin(axis=0)
    low = bits[best, np.arange(n)]
    bits[best, np.arange(n)] = np.inf
    second = bits.min(axis=0)
    score = np.ones(n)
    np.divide(low, second, out=score, where=np.isfinite(second) & (second > 0))
    score = np.where(np.isfinite(second), 1 - score, 1.0)
    return [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score), learning from ``training`` (doc_id, text, lang)."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(training))
    kind = dict(docs.dtypes)["doc_id"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score = predict_block(batch.column(1), sent.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)],
                                          ["doc_id", "lang_pred", "score"])
    return B.map_text(docs.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, training: DataFrame) -> DataFrame:
    """The documents, all columns, whose language is known (not ``und``)."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(training))
    place = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, _ = predict_block(batch.column(place), sent.value)
        return batch.filter(pa.array([name != UNKNOWN for name in names]))
    return B.map_text(docs, work, docs.schema)
