"""Near duplicates by ProbMinHash signatures, banding and exact verification.

Shingles of five words are weighted by 1 + ln(count). For each of them a Poisson process
whose rate is its weight is run; an arrival picks a register, which keeps the earliest
arrival it sees. A text's processes end as soon as their next arrival is later than every
register's. Two texts agree on a register with the probability Jaccard similarity of
their weighted shingles. The same processes are run with all weights one, too: then it is
the set Jaccard similarity, which a link asks for, whatever repeats inside the texts.
Bands of the registers of both are bucketed, and in each bucket the texts are compared
with the bucket's hub: the member that meets most texts over all its buckets, as the
source of a family of edited copies does. Comparison is exact: shared over all distinct
shingles, at least 0.8. Members that are in another class than their hub after that are
compared with each other and with the members of the hub's class, exactly and all of
them: they are dealt into cells of at most two chunks of ``CHUNK`` members, compared
inside the cell, and only edges of classes leave it. So the classes are those of all
links between texts that share a bucket. Links are joined to classes by alternating star
steps.

Equal texts are put together first, by a digest, and enter as one.

Edge cases: texts of fewer than five words have all their words as one shingle; wordless
texts are only alike if equal; a null text is alike to nothing; rows with equal ids are
one document; rows without an id are not classed; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale
from ..runtime import materialise
from . import blocks as B
from .decontaminate import text_words

SHINGLE = 5
#: Similarity of a link, as a fraction.
SHARED, OF = 8, 10
#: Bands and registers per band, of either weighting: a pair at 0.8 misses all bands of weight one once in 70,000.
BANDS, BAND_SIZE = 28, 5
REGISTERS = BANDS * BAND_SIZE
#: Members of a bucket that are compared with each other in one piece.
CHUNK = 256

_ROW_SHIFT = np.uint64(50)
_LOW = np.uint64(0xFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles, by row; a shingle is 50 bits of hash."""
    words, rows, counts = text_words(column)
    begin = np.concatenate([[0], np.cumsum(counts)])
    keys = []
    for n in range(1, SHINGLE + 1):
        grams = B.gram_hash(words, n)
        if n == SHINGLE:
            at = np.flatnonzero(rows[n - 1:] == rows[:len(rows) - n + 1]) if len(grams) else np.empty(0, np.int64)
        else:
            at = begin[:-1][counts == n]
        keys.append(rows[at].astype(np.uint64) << _ROW_SHIFT | grams[at] >> np.uint64(64) - _ROW_SHIFT)
    found, times = np.unique(np.concatenate(keys), return_counts=True)
    return (found >> _ROW_SHIFT).astype(np.int64), found & (np.uint64(1) << _ROW_SHIFT) - np.uint64(1), times


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int,
               registers: int = REGISTERS) -> np.ndarray:
    """n x registers elements: each register's earliest arrival. Rows without elements stay all ones.

    Register entries are packed as arrival time (bits of a positive float keep its
    order) and element, so one minimum keeps both.
    """
    kept = np.full(n * registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    active, time, step = np.arange(len(rows)), np.zeros(len(rows)), np.uint64(0)
    while len(active):
        step += np.uint64(1)
        with np.errstate(over="ignore"):
            draw = B.mix(elements[active] * _GOLDEN + step)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53
        time[active] -= np.log(uniform) / weights[active]
        bits = time[active].astype(np.float32).view(np.uint32).astype(np.uint64)
        register = ((draw & np.uint64(2047)) * np.uint64(registers) >> np.uint64(11)).astype(np.int64)
        row = rows[active]
        np.minimum.at(kept, row * registers + register, bits << np.uint64(32) | elements[active] & _LOW)
        # rows stand together, so each one's latest register is looked up once
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        latest = kept.reshape(n, registers)[row[first]].max(axis=1) >> np.uint64(32)
        active = active[bits < np.repeat(latest, np.diff(np.append(first, len(row))))]
    return (kept & _LOW).reshape(n, registers)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands hashes of runs of registers; the band's number is part of it."""
    n, registers = signature.shape
    parts = signature.reshape(n, bands, registers // bands)
    total = np.broadcast_to(B.stream(41, bands), (n, bands)).copy()
    with np.errstate(over="ignore"):
        for j in range(registers // bands):
            total = B.mix(total * _GOLDEN + parts[:, :, j])
    return total


def text_bands(rows: np.ndarray, elements: np.ndarray, times: np.ndarray, n: int) -> pa.ListArray:
    """Band hashes of n texts: those of weights one, then those of weights by count that differ from them."""
    plain = band_hashes(signatures(rows, elements, np.ones(len(rows)), n))
    made = np.concatenate([plain, plain], axis=1)
    repeats = np.zeros(n, bool)
    repeats[rows[times > 1]] = True
    at = repeats[rows]  # without a repeated shingle both weightings are the same
    if at.any():
        few = band_hashes(signatures((np.cumsum(repeats) - 1)[rows[at]], elements[at], 1 + np.log(times[at]),
                                     int(repeats.sum())))
        made[repeats, BANDS:] = few
    new = np.repeat((np.bincount(rows, minlength=n) > 0)[:, None], 2 * BANDS, axis=1)
    new[:, BANDS:] &= made[:, BANDS:] != plain
    offsets = np.concatenate([[0], np.cumsum(new.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(made[new].view(np.int64)))


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands): digest of the text and its band hashes, none without words."""
    kind = dict(docs.dtypes)["doc_id"]
    # a null text has a digest of its own
    digest = F.coalesce(F.substring(F.unhex(F.sha2("text", 256)), 1, 16),
                        F.concat(F.lit("null ").cast("binary"), F.col("doc_id").cast("string").cast("binary")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, elements, times = shingles(batch.column(2))
        lists = text_bands(rows, elements, times, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "digest", "bands"])
    return B.map_text(docs.filter("doc_id is not null").select("doc_id", digest.alias("digest"), "text"), work,
                      f"doc_id {kind}, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles array<long>) of the documents named in ``wanted`` (node)."""
    kind = dict(wanted.dtypes)["node"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, elements, _ = shingles(batch.column(1))
        offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "shingles"])
    chosen = docs.select(F.col("doc_id").alias("node"), "text").join(scale.bounded(wanted), "node", "left_semi")
    return B.map_text(chosen, work, f"node {kind}, shingles array<long>").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (node, hub) with ``alike``: shared over all distinct shingles reaches the threshold."""
    hubs = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("_theirs"))
    shared = F.size(F.array_intersect("shingles", "_theirs"))
    union = F.size("shingles") + F.size("_theirs") - shared
    return (pairs.join(hubs, "hub").join(sets, "node")
            .select("node", "hub", (OF * shared >= SHARED * union).alias("alike")))


def compare_cell(cell: pa.Table) -> pa.Table:
    """Class edges (node, hub) between the two chunks i and j of a cell, or within it if they are one.

    Shared shingles are counted by products of blocks of the members' 0/1 rows. Each member
    is joined to the first one that its links lead to inside the cell: no more edges than members.
    """
    sets = cell.column("shingles").combine_chunks()
    sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
    sizes = np.diff(sets.offsets.to_numpy())
    member = np.repeat(np.arange(len(sizes)), sizes)
    values, at, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = times[at] > 1  # a shingle of one member is shared with none
    column, member = (np.cumsum(times > 1) - 1)[at[several]], member[several]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    shared = np.zeros((len(sizes), len(sizes)), np.float64)
    for low in range(0, int((times > 1).sum()), 2048):
        a, b = np.searchsorted(column, [low, low + 2048])
        rows = np.zeros((len(sizes), 2048), np.float32)
        rows[member[a:b], column[a:b] - low] = 1
        shared += rows @ rows.T
    alike = OF * shared >= SHARED * (sizes[:, None] + sizes[None, :] - shared)
    if cell.column("i")[0].as_py() != cell.column("j")[0].as_py():
        chunk = cell.column("chunk").to_numpy()
        alike &= chunk[:, None] != chunk[None, :]
    np.fill_diagonal(alike, True)
    first, before = np.arange(len(sizes)), None
    while before is None or (first != before).any():
        before, first = first, np.where(alike, first[None, :], len(sizes)).min(axis=1)
        first = first[first]
    joined = np.flatnonzero(first != np.arange(len(sizes)))
    nodes = cell.column("node")
    return pa.table({"node": nodes.take(pa.array(joined)), "hub": nodes.take(pa.array(first[joined]))})


def compare_rest(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Class edges among the members of each band of ``rest`` (node, band, same).

    ``same`` marks the members of the hub's class. The others are compared with each other
    and with those. Their chunks are numbered from 0 up, those of the hub's class from -1 down.
    """
    other = ~F.col("same")
    sizes = materialise(rest.groupBy("band").agg(F.ceil(F.count_if(other) / CHUNK).alias("_n"),
                                                 F.ceil(F.count_if("same") / CHUNK).alias("_m"),
                                                 F.count("*").alias("_size"))
                        .filter("_size > 1 and _n > 0").drop("_size"), "rest-sizes")
    others = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    theirs = F.when(F.col("_m") > 0, F.sequence(F.lit(-1).cast("long"), -F.col("_m"))).otherwise(
        F.array().cast("array<long>"))
    place = F.xxhash64("node")
    dealt = (rest.join(sizes, "band")
             .withColumn("chunk", F.when(other, F.pmod(place, F.col("_n"))).otherwise(-1 - F.pmod(place, F.col("_m"))))
             .withColumn("_other", F.explode(F.when(other, F.concat(others, theirs)).otherwise(others)))
             .select("node", "band", "chunk", F.least("chunk", "_other").alias("i"),
                     F.greatest("chunk", "_other").alias("j")))
    cells = dealt.join(sets, "node").groupBy("band", "i", "j")
    kind = dict(rest.dtypes)["node"]
    return cells.applyInArrow(compare_cell, f"node {kind}, hub {kind}").distinct()


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hub) verified links between the nodes (node, bands) of different texts."""
    entries = materialise(nodes.select("node", F.explode("bands").alias("band")), "band-entries")
    sizes = materialise(entries.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "band-sizes")
    entries = materialise(entries.join(sizes, "band"), "band-entries")
    met = materialise(entries.groupBy("node").agg(F.sum("size").alias("met")), "band-met")
    entries = materialise(entries.select("node", "band").join(met, "node"), "band-entries")
    hubs = materialise(entries.groupBy("band").agg(F.max(F.struct("met", "node")).alias("_best"))
                       .select("band", F.col("_best.node").alias("hub")), "band-hubs")
    tried = materialise(entries.join(hubs, "band").filter("node <> hub").select("node", "hub", "band"), "band-tried")
    sets = materialise(shingle_sets(docs, met.select("node")), "shingle-sets")
    checked = materialise(verify(tried.select("node", "hub").distinct(), sets), "band-checked")
    alike = checked.filter("alike").select("node", "hub")
    roots = materialise(components(alike), "hub-roots")
    theirs = roots.select(F.col("node").alias("hub"), F.col("root").alias("_theirs"))
    rest = tried.join(roots, "node", "left").join(theirs, "hub", "left").select(
        "node", "band", (F.coalesce("root", "node") == F.coalesce("_theirs", "hub")).alias("same"))
    return alike.union(compare_rest(materialise(rest, "band-rest"), sets))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable from each node of ``edges`` (node, hub).

    Large-star and small-star steps in turn, till a round changes nothing. Every step
    is written, so a lost executor costs one step at most.
    """
    now = materialise(edges.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct(),
                      "stars")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")),
                            "least")
        large = materialise(both.filter("v > u").join(least, "u")
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
        now = materialise(small.filter("u <> v").distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): one row per row of ``docs`` with an id; the class is its least id."""
    drawn = materialise(sketch(docs), "sketch")
    groups = materialise(drawn.groupBy("digest").agg(F.min("doc_id").alias("node")), "copies")
    members = materialise(drawn.join(groups, "digest").select(
        "doc_id", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands")), "members")
    nodes = members.filter("bands is not null").select("node", "bands").dropDuplicates(["node"])
    # an id with several texts is a member of several groups: those are one class, too
    several = members.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("hub")) \
        .filter("node <> hub").select("node", "hub")
    roots = materialise(components(links(docs, nodes).union(several)), "roots")
    return members.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one of each class: that of the least id.

    Rows without an id stay; of rows with equal ids one stays.
    """
    found = materialise(classes(docs), "classes")
    gone = found.filter("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(scale.bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    if not found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.filter("doc_id is null"))
    return kept
