"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each decision has a tree of contexts, the bytes before
it up to ``DEPTH``. Every node has a Krichevsky-Trofimov estimate, and a node's weighted
probability is half its own estimate plus half the product of its children's. All depths
are so mixed without a choice of order, and the sum over a text is its code length.

Counts of all training text are gathered by Spark, and every context seen keeps its node:
none is cut. No process holds the tree. Grams are written with the nearest byte first, so a
context of any depth is a prefix and all below three nearest bytes lies in one *slice* (a
range of about ``SLICE`` distinct grams). A slice works out its nodes of depth 3 and more,
and its evidence is summed into the nodes of two bytes and fewer, the *top*, which every
task gets (a node per pair of bytes and decision seen). Texts are dealt to *lots*; a lot
asks the slices for its distinct grams, and each position of its texts takes the answer.

Word unigrams with add-one smoothing are scored beside it. Counts of the most frequent
words (at most ``HOT_WORDS``) go to every task; tokens of all other words are counted per
document and joined with the word table by shuffle.

A-Z are lower-cased. A text is closed by an end symbol, which both models score.

Edge cases: null texts are empty texts; rows without an id are scored as others; equal
rows (id and text) each get their result; without training text every byte costs 8 bits
and every token has log10(1 / (N + V + 1)) with N = V = 0; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, ship
from . import blocks as B

DEPTH = 5
#: Bound of the broadcast word table.
HOT_WORDS = 1 << 19
#: Distinct grams of a slice, and bytes of text of a lot.
SLICE, LOT = 1 << 17, 8 << 20
#: Depth of the top.
TOP = 2
PIECE = 256
#: Partial counts a task gathers before it hands them on.
GATHER = 700_000
#: The end token's name among words; no word has white space.
END = "\n"


def padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with DEPTH zeros before and an end zero behind each row, and the rows' starts."""
    lengths = np.diff(bounds)
    begin = bounds[:-1] + np.arange(len(lengths)) * (DEPTH + 1)
    out = np.zeros(len(data) + len(lengths) * (DEPTH + 1), np.uint8)
    out[np.arange(len(data)) + np.repeat(begin + DEPTH - bounds[:-1], lengths)] = data
    return out, begin


def byte_grams(data: np.ndarray, bounds: np.ndarray, near_first: bool = False) -> np.ndarray:
    """DEPTH bytes of context and the byte behind them, packed, for each byte and end.

    With ``near_first`` the context is turned round, so that a shorter one is a prefix.
    """
    out, begin = padded(data, bounds)
    grams = np.zeros(len(out) - DEPTH, np.int64) if len(out) else np.empty(0, np.int64)
    for j in [*range(DEPTH)[::-1 if near_first else 1], DEPTH]:
        grams = grams << 8 | out[j:len(out) - DEPTH + j]
    inside = np.ones(len(out), bool)
    for j in range(DEPTH):
        inside[begin + j] = False
    return grams[inside[DEPTH:]]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, where each first stands, summed counts)."""
    found, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return found, first, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


class _Counter:
    """Counts of byte grams and words of a task, handed on in bounded lots."""

    def __init__(self) -> None:
        self.grams, self.gram_counts = [], []
        self.words, self.word_counts, self.names = [], [], []
        self.ends = 0

    def add(self, column: pa.Array) -> Iterator[pa.RecordBatch]:
        data, bounds = B.text_bytes(column)
        data = B.LOWER[data]
        self.ends += len(column)
        grams, counts = np.unique(byte_grams(data, bounds, near_first=True), return_counts=True)
        self.grams.append(grams)
        self.gram_counts.append(counts)
        starts, ends, _ = B.segments(data, bounds, B.NOT_SPACE)
        words, first, counts = np.unique(B.span_hash(data, starts, ends), return_index=True, return_counts=True)
        self.words.append(words.view(np.int64))
        self.word_counts.append(counts)
        self.names.append(B.take_strings(data, starts[first], ends[first]))
        if sum(map(len, self.grams)) > GATHER:
            found, _, counts = _merged(self.grams, self.gram_counts)
            self.grams, self.gram_counts = [found], [counts]
            if len(found) > GATHER // 2:
                yield from self.take_grams()
        if sum(map(len, self.words)) > GATHER:
            found, first, counts = _merged(self.words, self.word_counts)
            self.names = [pa.concat_arrays(self.names).take(pa.array(first))]
            self.words, self.word_counts = [found], [counts]
            if len(found) > GATHER // 2:
                yield from self.take_words()

    def take_grams(self) -> Iterator[pa.RecordBatch]:
        if self.grams:
            found, _, counts = _merged(self.grams, self.gram_counts)
            yield from _lots(np.ones(len(found), np.int8), found, pa.nulls(len(found), pa.string()), counts)
        self.grams, self.gram_counts = [], []

    def take_words(self) -> Iterator[pa.RecordBatch]:
        if self.words:
            found, first, counts = _merged(self.words, self.word_counts)
            yield from _lots(np.zeros(len(found), np.int8), found, pa.concat_arrays(self.names).take(pa.array(first)), counts)
        self.words, self.word_counts, self.names = [], [], []

    def take(self) -> Iterator[pa.RecordBatch]:
        yield from self.take_grams()
        yield from self.take_words()
        if self.ends:
            yield from _lots(np.zeros(1, np.int8), np.zeros(1, np.int64), pa.array([END]), np.array([self.ends]))


def _lots(kind: np.ndarray, key: np.ndarray, word: pa.Array, n: np.ndarray, size: int = 100_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), word, pa.array(n.astype(np.int64))],
                                       ["kind", "key", "word", "n"])
    for at in range(0, len(key), size):
        yield whole.slice(at, size)


def count_text(docs: DataFrame) -> DataFrame:
    """(kind, key, word, n): words (kind 0, key is the hash) and byte grams (kind 1, nearest byte first) of all texts, counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for block in B.blocks(batches):
            yield from counter.add(block.column(0))
        yield from counter.take()
    ship(docs.sparkSession)
    partial = docs.select("text").mapInArrow(run, "kind byte, key long, word string, n long")
    return partial.groupBy("kind", "key", "word").agg(F.sum("n").alias("n"))


def count_limit(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows of ``counts`` (n) reach, on a scale of sixteenths of doublings."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * 16)
    rows = counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("rows"), F.min("n").alias("least")) \
        .orderBy(F.desc("grade")).collect()  # a row per sixteenth of a doubling
    total, limit = 0, 1 << 62
    for row in rows:
        total += row["rows"]
        if total > most:
            break
        limit = row["least"]
    return limit


@dataclass
class Tree:
    """Contexts as states: log10 of each byte's probability, and the next state."""

    logs: np.ndarray
    following: np.ndarray

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each row with its end, pieces of the rows side by side."""
        out, begin = padded(data, bounds)
        edges = np.concatenate([[0], np.cumsum(np.diff(bounds) + 1)])
        start, length, row = B.lanes(edges, PIECE)
        # a piece starts DEPTH bytes early, which leads to the state it must start in
        start = start - edges[:-1][row] + begin[row]
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start))
        logs, following = self.logs.ravel(), self.following.ravel()
        if len(start):
            for step in range(int(length[0]) + DEPTH):
                n = int(np.searchsorted(-length, -(step - DEPTH), side="left"))
                at = state[:n] * 256 + out[start[:n] + step]
                if step >= DEPTH:
                    total[:n] += logs[at]
                state[:n] = following[at]
        return np.bincount(row, total, len(bounds) - 1)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of counts."""
    return _gamma(zeros + 0.5) + _gamma(ones + 0.5) - 2 * math.lgamma(0.5) - _gamma(zeros + ones + 1.0)


def _gamma(x: np.ndarray) -> np.ndarray:
    """log-gamma by Stirling's series, the argument raised above 8 first."""
    shift, z = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = z < 8
        if not small.any():
            break
        shift[small] += np.log(z[small])
        z[small] += 1
    inverse = 1 / z
    series = inverse * (1 / 12 - inverse ** 2 * (1 / 360 - inverse ** 2 * (1 / 1260 - inverse ** 2 / 1680)))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) at the 255 decisions of a byte, from counts of its 256 values."""
    heap = np.zeros((len(counts), 512))
    heap[:, 256:] = counts
    for level in (128, 64, 32, 16, 8, 4, 2, 1):
        heap[:, level:2 * level] = heap[:, 2 * level:4 * level:2] + heap[:, 2 * level + 1:4 * level:2]
    return heap[:, 0:512:2], heap[:, 1:512:2]  # decision i stands at i; entry 0 is not used


def _chances(counts: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov chances of zero and of one at the decisions of a byte."""
    zero, one = _bits(counts)
    return (np.stack([zero, one]) + 0.5) / (zero + one + 1)


def _parts(mask: np.ndarray, size: int = 1024) -> Iterator[np.ndarray]:
    """Marked rows, a bounded number at a time."""
    at = np.flatnonzero(mask)
    for low in range(0, len(at), size):
        yield at[low:low + size]


def build_tree(depth: np.ndarray, context: np.ndarray, value: np.ndarray, n: np.ndarray) -> Tree:
    """Tree of contexts from counts: context of so many bytes, the byte behind, how often.

    The context of depth 0 has all counts. One table in memory, for few contexts: texts are
    scored through :func:`answers`, which tests compare with it.
    """
    key = depth.astype(np.int64) << 40 | context  # DEPTH bytes fit in 40 bits
    names = np.unique(np.append(key, 0))
    place = np.searchsorted(names, key)
    level = (names >> 40).astype(int)
    tail = names & (1 << 40) - 1
    parent = np.zeros(len(names), np.int64)  # without the oldest byte
    for d in range(1, DEPTH + 1):
        at = level == d
        parent[at] = np.searchsorted(names, (d - 1) << 40 | tail[at] & (1 << 8 * (d - 1)) - 1)
    # counts and log evidences grow with the text and are subtracted: float32 would round them above 2^24
    counts = np.zeros((len(names), 256))
    np.add.at(counts, (place, value), n)
    rest = counts.copy()  # of each context, what no kept deeper one has
    np.subtract.at(rest, parent[level > 0], counts[level > 0])
    np.maximum(rest, 0, out=rest)
    keep, below = np.zeros((len(names), 256), np.float32), np.zeros((len(names), 256))
    for d in range(DEPTH, -1, -1):
        for at in _parts(level == d):
            own = _estimate(*_bits(counts[at]))
            if d < DEPTH:
                children = below[at] + _estimate(*_bits(rest[at]))
                keep[at] = 1 / (1 + np.exp(np.clip(children - own, -60, 60)))  # weight of the own estimate
                own = np.logaddexp(own, children) - math.log(2)
            if d:
                np.add.at(below, parent[at], own)
    del below
    # both outcomes have their own sums: one minus a chance that rounds to one would be zero, its log not finite
    share = np.ones((len(names), 256), np.float32)
    sure = np.zeros((2, len(names), 256), np.float32)
    logs, values = np.zeros((len(names), 256), np.float32), np.arange(256)
    for d in range(DEPTH + 1):
        for at in _parts(level == d):
            before, known = (share[parent[at]], sure[:, parent[at]]) if d else (1.0, 0.0)
            own = _chances(counts[at])
            if d == DEPTH:
                chances = known + before * own
            else:
                share[at] = before * (1 - keep[at])
                sure[:, at] = known + before * keep[at] * own
                chances = sure[:, at] + share[at] * _chances(rest[at])
            for bit in range(8):
                node = (256 + values) >> (8 - bit)
                logs[at] += np.log10(np.where(values >> (7 - bit) & 1, chances[1][:, node], chances[0][:, node]))
    del share, sure, rest, keep, counts
    following = np.zeros((len(names), 256), np.min_scalar_type(len(names)))
    for d in range(DEPTH + 1):
        at = np.flatnonzero(level == d)
        if d:
            following[at] = following[parent[at]]
        if d < DEPTH:
            more = np.flatnonzero(level == d + 1)
            following[np.searchsorted(names, d << 40 | tail[more] >> 8), tail[more] & 255] = more
    return Tree(logs, following)


@dataclass
class Nodes:
    """Decisions of a depth and level seen in training, sorted by (context, bits before): counts, weight of the own estimate."""

    keys: np.ndarray
    counts: np.ndarray  # zeros, ones
    keep: np.ndarray


_SMALL = 1 << 12
_HALF, _WHOLE = (np.array([math.lgamma(i + x) for i in range(_SMALL)]) for x in (0.5, 1.0))


def _log_gamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """lgamma(n + shift) of counts, from its table for small ones."""
    out = table[np.minimum(n, _SMALL - 1)]
    large = n >= _SMALL
    out[large] = _gamma(n[large] + shift)
    return out


def _evidence(counts: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of (zeros, ones)."""
    zeros, ones = counts
    return _log_gamma(zeros, _HALF, 0.5) + _log_gamma(ones, _HALF, 0.5) - 2 * math.lgamma(0.5) \
        - _log_gamma(zeros + ones, _WHOLE, 1.0)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


def _decisions(pairs: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, (zeros, ones)) at the eight levels of a depth, from sorted (context, byte) and how often."""
    made = []
    for _ in range(8):
        keys, ones = pairs >> 1, n * (pairs & 1)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        total, ones = (np.add.reduceat(x, first) if len(first) else np.empty(0, np.int64) for x in (n, ones))
        pairs, n = keys[first], total
        made.append((pairs, np.stack([total - ones, ones])))
    return made[::-1]


def _shorter(keys: np.ndarray, level: int) -> np.ndarray:
    """Keys of the same decision under the context without its farthest byte."""
    return keys >> 8 + level << level | keys & (1 << level) - 1


def _deep(pairs: np.ndarray, n: np.ndarray, depths: range, below: list[tuple] | None):
    """(nodes per depth and level, (keys, evidence) of the first depth per level).

    ``pairs`` are (context, byte) of the last depth. ``below`` has the evidence under its
    nodes, (keys, sums) per level; None where no context goes deeper.
    """
    nodes: dict[int, list[Nodes]] = {}
    for d in reversed(depths):
        nodes[d], up = [], []
        for level, (keys, counts) in enumerate(_decisions(pairs, n)):
            own = _evidence(counts)
            keep = np.ones(len(keys))  # nothing goes deeper
            if below:
                under = np.bincount(np.searchsorted(keys, below[level][0]), below[level][1], len(keys))
                keep = 1 / (1 + np.exp(np.clip(under - own, -60, 60)))
                own = np.logaddexp(own, under) - math.log(2)
            nodes[d].append(Nodes(keys, counts, keep))
            up.append((keys, own))
        below = [_summed(_shorter(keys, level), own) for level, (keys, own) in enumerate(up)]
        pairs, n = _summed(_shorter(pairs, 8), n)
    return nodes, below


def _chances_of(grams: np.ndarray, nodes: dict[int, list[Nodes]]) -> np.ndarray:
    """log10 of the mixed probability of each gram's last byte after its context."""
    logs = np.zeros(len(grams))
    byte = grams & 255
    for level in range(8):
        bit = (byte >> 7 - level) & 1
        chance, share = np.zeros(len(grams)), np.ones(len(grams))
        for d in range(DEPTH + 1):
            table, keys = nodes[d][level], grams >> 8 * (DEPTH + 1 - d) << level | byte >> 8 - level
            if not len(table.keys):
                chance, share = chance + share / 2, share * 0
                continue
            at = np.minimum(np.searchsorted(table.keys, keys), len(table.keys) - 1)
            seen = table.keys[at] == keys
            # what was never seen has even chances there and below
            own = np.where(seen, (table.counts[bit, at] + 0.5) / (table.counts[0, at] + table.counts[1, at] + 1), 0.5)
            keep = np.where(seen, table.keep[at], 1.0)
            chance, share = chance + share * keep * own, share * (1 - keep)
        logs += np.log10(chance)
    return logs


def _edges(grams: DataFrame) -> np.ndarray:
    """Last grams of the slices but the last, at about ``SLICE`` distinct grams each; TOP + 1 nearest bytes stay together."""
    shift = 8 * (DEPTH - TOP)
    found = grams.groupBy(F.shiftright("key", shift).alias("near")).agg(F.count("*").alias("rows")).toArrow()
    near, rows = found["near"].to_numpy(), found["rows"].to_numpy()  # a row per three bytes that follow each other
    order = np.argsort(near)
    number = (np.cumsum(rows[order]) - rows[order]) // SLICE
    last = np.flatnonzero(np.diff(number))
    return (near[order][last] + 1 << shift) - 1


def _slice(edges: np.ndarray) -> Column:
    """The slice of the column key."""
    @F.pandas_udf("int")
    def found(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy()).astype(np.int32))
    return found(F.col("key"))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[name].to_numpy() for name in names]


def learn_top(grams: DataFrame) -> dict[int, list[Nodes]]:
    """Nodes of at most ``TOP`` bytes, from grams (slice, key, n): the slices' evidence, summed."""
    def work(table: pa.Table) -> pa.Table:
        keys, n = _columns(table, "key", "n")
        keys, n = _summed(keys, n)
        _, up = _deep(keys, n, range(TOP + 1, DEPTH + 1), None)
        # level 8: how often a byte stands behind two bytes
        up.append(_summed(keys >> 8 * (DEPTH + 1 - TOP) << 8 | keys & 255, n))
        return pa.table({"level": np.repeat(np.arange(9, dtype=np.int8), [len(k) for k, _ in up]),
                         "key": np.concatenate([k for k, _ in up]),
                         "value": np.concatenate([v.astype(float) for _, v in up])})

    parts = grams.groupBy("slice").applyInArrow(work, "level byte, key long, value double")
    level, keys, values = _columns(parts.groupBy("level", "key").agg(F.sum("value").alias("value")).toArrow(),
                                   "level", "key", "value")
    below = [_summed(keys[level == i], values[level == i]) for i in range(9)]
    pairs, n = below.pop()
    return _deep(pairs, np.round(n).astype(np.int64), range(TOP + 1), below)[0]


def _packed(keys: np.ndarray) -> bytes:
    """Sorted grams as steps, byte by byte of their places, which compress."""
    return np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def _distinct(grams: np.ndarray) -> np.ndarray:
    """Sorted, each once: a plain sort is several times faster here than the hash table of ``np.unique``."""
    grams = np.sort(grams)
    return grams[np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))] if len(grams) else grams


def deal(docs: DataFrame, edges: np.ndarray) -> DataFrame:
    """Texts (doc_id, text_hash, text) with their lot, and what a lot asks each slice: (lot, slice, asked)."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = f"lot long, doc_id {ids}, text_hash long, text string, slice int, asked binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, grams, kinds = TaskContext.get().partitionId() << 32, 0, np.empty(0, np.int64), None

        def rows(lots: int, kept: list[pa.Array], slices: np.ndarray | None, asked: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(lots, number)), *kept, pa.nulls(lots, pa.int32()) if slices is None else pa.array(slices, pa.int32()),
                 pa.nulls(lots, pa.binary()) if asked is None else pa.array(asked, pa.binary())],
                ["lot", "doc_id", "text_hash", "text", "slice", "asked"])

        def ask() -> pa.RecordBatch:
            cut = np.split(grams, np.searchsorted(grams, edges, side="right"))
            used = [i for i, part in enumerate(cut) if len(part)]
            return rows(len(used), [pa.nulls(len(used), kind) for kind in kinds], np.array(used, np.int32),
                        [_packed(cut[i]) for i in used])

        for block in B.blocks(batches):
            kept = [block.column(i) for i in range(3)]
            kinds = [c.type for c in kept]
            yield rows(block.num_rows, kept, None, None)
            data, bounds = B.text_bytes(kept[2])
            fresh = _distinct(byte_grams(B.LOWER[data], bounds, near_first=True))
            grams = _distinct(np.concatenate([grams, fresh]))
            size += kept[2].nbytes
            if size >= LOT:
                yield ask()
                number, size, grams = number + 1, 0, np.empty(0, np.int64)
        if len(grams):
            yield ask()
    ship(docs.sparkSession)
    return materialise(docs.mapInArrow(run, schema), "lots")


def answers(grams: DataFrame, asked: DataFrame, top: dict[int, list[Nodes]]) -> DataFrame:
    """(lot, slice, logs): log10 of the probability of each gram that (lot, slice, asked) names, from grams (slice, key, n)."""
    sent = grams.sparkSession.sparkContext.broadcast(top)

    def work(known: pa.Table, wanted: pa.Table) -> pa.Table:
        keys, n = _columns(known, "key", "n")
        nodes, _ = _deep(*_summed(keys, n), range(TOP + 1, DEPTH + 1), None)
        each = [_unpacked(data) for data in wanted["asked"].to_pylist()]
        found = _distinct(np.concatenate(each)) if each else np.empty(0, np.int64)
        logs = np.concatenate([_chances_of(part, sent.value | nodes) for part in np.array_split(found, 1 + len(found) // SLICE)])
        logs = logs.astype(np.float32)
        return pa.table({"lot": wanted["lot"], "slice": wanted["slice"],
                         "logs": pa.array([logs[np.searchsorted(found, part)].tobytes() for part in each], pa.binary())})
    return grams.groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(work, "lot long, slice int, logs binary")


@dataclass
class HotWords:
    hashes: np.ndarray
    logs: np.ndarray
    end: float
    known_end: int


def word_log(count: Column | int, tokens: int, distinct: int):
    if isinstance(count, Column):
        return F.log10((count + 1) / F.lit(float(tokens + distinct + 1)))
    return math.log10((count + 1) / (tokens + distinct + 1))


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    counts = materialise(count_text(training), "text-counts")
    words = counts.filter("kind = 0").select("key", "word", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"),
                     F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0)).alias("ends")).first()
    tokens, distinct = sums["tokens"], sums["distinct"]
    grams = counts.filter("kind = 1").select("key", "n")
    edges = _edges(grams)
    grams = grams.withColumn("slice", _slice(edges))
    top = learn_top(grams)
    plain = words.filter(F.col("word") != END)
    limit = count_limit(plain, HOT_WORDS)
    hot = plain.filter(F.col("n") >= limit).select("key", "n").toArrow()
    order = np.argsort(hot["key"].to_numpy().view(np.uint64))
    spark = docs.sparkSession
    table = HotWords(hot["key"].to_numpy().view(np.uint64)[order],
                     np.log10((hot["n"].to_numpy()[order] + 1) / (tokens + distinct + 1)),
                     word_log(sums["ends"], tokens, distinct), int(sums["ends"] > 0))
    sent = spark.sparkContext.broadcast(table)
    kind = dict(docs.dtypes)["doc_id"]
    lots = deal(docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text"), edges)
    replies = answers(grams, lots.filter("slice is not null").select("lot", "slice", "asked"), top)

    def work(texts: pa.Table, replies: pa.Table) -> pa.Table:
        return _score_lot(texts, replies, sent.value)
    scored = lots.filter("slice is null").select("lot", "doc_id", "text_hash", "text").groupBy("lot").cogroup(
        replies.groupBy("lot")).applyInArrow(
        work, f"doc_id {kind}, text_hash long, word string, times long, copies long, n_bytes long, n_tokens long, "
        "n_known long, base double, score double")
    rare = plain.filter(F.col("n") < limit).select("word", F.col("n").alias("_count"))
    rows = materialise(scored, "scored")
    sent.unpersist()  # what was scored is stored
    found = rows.filter("word is not null").join(rare, "word", "left").withColumn("_count", F.coalesce("_count", F.lit(0)))
    found = found.withColumn("n_known", F.when(F.col("_count") > 0, F.col("times")).otherwise(0)) \
        .withColumn("base", F.col("times") * word_log(F.col("_count"), tokens, distinct))
    # one group per id and text; equal rows share it and are told apart again at the end
    figures = ["n_bytes", "n_tokens", "n_known", "base", "score"]
    parts = rows.filter("word is null").select("doc_id", "text_hash", "copies", *figures).union(
        found.select("doc_id", "text_hash", "copies", *figures))
    whole = parts.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies"), *[F.sum(c).alias(c) for c in figures])
    again = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    each = [(F.col(c) / F.col("copies")).cast("long").alias(c) for c in figures[:3]]
    return again.select("doc_id", *each, F.lit(tokens).cast("long").alias("train_tokens"),
                        (F.col("base") / F.col("copies")).alias("base_score"),
                        (F.col("score") / F.col("copies")).alias("score"))


def _score_lot(texts: pa.Table, replies: pa.Table, hot: HotWords) -> pa.Table:
    """The rows of :func:`_score_block` of a lot's texts; its grams in order have the replies in the slices' order."""
    order = np.argsort(replies["slice"].to_numpy())
    logs = np.frombuffer(b"".join(replies["logs"].take(pa.array(order)).to_pylist()), np.float32)
    parts = []
    for block in B.blocks(iter(texts.select(["doc_id", "text_hash", "text"]).to_batches())):
        data, bounds = B.text_bytes(block.column(2))
        found, at = np.unique(byte_grams(B.LOWER[data], bounds, near_first=True), return_inverse=True)
        parts.append((block, np.diff(bounds) + 1, found, at.astype(np.int32)))
    grams = _distinct(np.concatenate([found for _, _, found, _ in parts]))
    made = []
    for block, lengths, found, at in parts:
        each = logs[np.searchsorted(grams, found)][at]
        made.append(_score_block(block, hot, np.bincount(np.repeat(np.arange(len(lengths)), lengths), each, len(lengths))))
    return pa.Table.from_batches(made)


def _score_block(batch: pa.RecordBatch, hot: HotWords, score: np.ndarray) -> pa.RecordBatch:
    """A row per text with what the task knows, and one per text and other word for the join."""
    data, bounds = B.text_bytes(batch.column(2))
    data, n = B.LOWER[data], batch.num_rows
    starts, ends, rows = B.segments(data, bounds, B.NOT_SPACE)
    words, first, at = np.unique(B.span_hash(data, starts, ends), return_index=True, return_inverse=True)
    place = np.minimum(np.searchsorted(hot.hashes, words), max(len(hot.hashes) - 1, 0))
    known = hot.hashes[place] == words if len(hot.hashes) else np.zeros(len(words), bool)
    logs = np.where(known, hot.logs[place], 0.0) if len(hot.hashes) else np.zeros(len(words))
    base = np.bincount(rows, logs[at], n) + hot.end
    n_known = np.bincount(rows, known[at], n).astype(np.int64) + hot.known_end
    other = ~known[at]
    pairs, times = np.unique(rows[other] * len(words) + at[other], return_counts=True)
    row, word = (pairs // len(words), pairs % len(words)) if len(words) else (pairs, pairs)
    names = B.take_strings(data, starts[first[word]], ends[first[word]])
    ids, hashes = (pa.concat_arrays([batch.column(i), batch.column(i).take(pa.array(row))]) for i in (0, 1))

    def column(values: np.ndarray, kind=np.int64) -> pa.Array:
        return pa.array(np.concatenate([values, np.zeros(len(row), kind)]).astype(kind))
    return pa.RecordBatch.from_arrays(
        [ids, hashes, pa.concat_arrays([pa.nulls(n, pa.string()), names]),
         pa.array(np.concatenate([np.zeros(n, np.int64), times])), column(np.ones(n)), column(np.diff(bounds)),
         column(np.bincount(rows, minlength=n) + 1), column(n_known), column(base, np.float64),
         column(score, np.float64)],
        ["doc_id", "text_hash", "word", "times", "copies", "n_bytes", "n_tokens", "n_known", "base", "score"])
