"""Product codes of vectors: parts, entries, rounds of Lloyd's step over boxed blocks.

Method. Vectors are made integer (``floor(256 * x)``) and sorted along a Hilbert curve
through the ``HILBERT_DIMS`` components of widest spread, then cut into flat blocks of
consecutive rows. A block is one written row: its vectors as an int32 matrix, the
min/max box of every component and the sums of every component. Each round, for every
part position, the box bounds the squared distance of all the block's rows to each
entry from below (``lb``) and above (``ub``); only entries with ``lb <= min(ub)`` can be
nearest, or tie with it, for any row of the block, so they form the block's shortlist.
Small exact int64 kernels evaluate the rows against that shortlist only; a shortlist of
one entry takes the whole block with its stored sums and no per-row work. Tasks add
sums and counts per (part, entry); Spark adds the tasks' rows; the driver receives
``parts x entries x part length`` numbers a round, never rows.

Contract (``op13``): a row is kept if its vector is not null, not empty, holds only
finite components with ``|x| < 32768`` (so every squared distance fits in int64) and has
the length of the vector that comes first in (vec_id, vector) order among such rows,
a multiple of ``PARTS``. Other rows are dropped. The codebook of each part starts as
that part of the ``ENTRIES`` first kept rows in (vec_id nulls last, vector) order;
repeated rows give equal entries, fewer kept rows give fewer entries. Each round
assigns every part to its nearest entry (ties to the lower index) and replaces each
used entry by the componentwise ``floor(sum / count)``; unused entries stay. After
``ROUNDS`` rounds parts are assigned once more. An empty table gives no rows.

Edge cases: null ``vec_id`` rows are kept and coded; null labels form one group for
``label_error``; other columns of the input are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale
from ..runtime import materialise, ship

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components of a kept vector are below this in magnitude.
LIMIT = 32768
#: Components that order rows along the Hilbert curve, and bits per component.
HILBERT_DIMS, HILBERT_BITS = 4, 15
#: Bytes of components a block holds, and its bounds in rows.
BLOCK_BYTES, LEAST_ROWS, MOST_ROWS = 256 << 10, 16, 1024
#: Bytes of components a range partition of the sorted rows holds.
PARTITION_BYTES = 64 << 20

_BLOCKS = "block long, ids array<long>, labels array<int>, n int, data binary, lo array<int>, hi array<int>, sums array<long>"
_SUMS = "part int, entry int, pos int, total long, n long"


def integer_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, e): the kept rows with integer components, and their length."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                             F.when(fine, F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int")))
                             .alias("e")).filter(F.col("e").isNotNull())
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "e").select(F.size("e").alias("d")).first()
    if first is None:
        return rows.limit(0), 0
    return rows.filter(F.size("e") == first["d"]), int(first["d"])


def seed_codebook(rows: DataFrame, dim: int) -> np.ndarray:
    """(parts, entries, part length) int64: parts of the first ``ENTRIES`` rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(ENTRIES).select("e").collect()
    seeds = np.array([r["e"] for r in first], np.int64).reshape(len(first), PARTS, dim // PARTS)
    return np.ascontiguousarray(seeds.transpose(1, 0, 2))


def hilbert_keys(coords: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``coords`` (n x d, integers below 2**bits), Skilling's transform."""
    x = coords.astype(np.uint64).copy()
    n, d = x.shape
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(d):
            hit = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(hit, x[:, 0] ^ p, x[:, 0] ^ t)
            if i:
                x[:, i] = np.where(hit, x[:, i], x[:, i] ^ t)
        q >>= np.uint64(1)
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[:, d - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if len(column) else pa.array([], pa.int32())
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.int32).reshape(len(column), dim)


def make_blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Hilbert-sorted flat blocks of ``rows``, written to the shared folder."""
    spread = rows.select(F.posexplode("e").alias("pos", "v")).groupBy("pos").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.variance("v").alias("var")).collect()  # one row per component
    widest = sorted(spread, key=lambda r: (-(r["var"] or 0.0), r["pos"]))[:HILBERT_DIMS]
    axes = np.array([r["pos"] for r in widest], np.int64)
    low = np.array([r["lo"] for r in widest], np.float64)
    width = np.maximum(np.array([r["hi"] for r in widest], np.float64) - low, 1.0)
    top = (1 << HILBERT_BITS) - 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _matrix(batch.column(2), dim)
            grid = np.clip(((e[:, axes] - low) / width * top).round(), 0, top).astype(np.int64)
            yield batch.append_column("hkey", pa.array(hilbert_keys(grid, HILBERT_BITS), pa.int64()))

    count = rows.count()
    spark = rows.sparkSession
    ship(spark)
    parts = max(spark.sparkContext.defaultParallelism, -(-count * dim * 4 // PARTITION_BYTES))
    sorted_rows = rows.withColumn("_seq", F.monotonically_increasing_id()) \
        .mapInArrow(keyed, "vec_id long, label int, e array<int>, _seq long, hkey long") \
        .repartitionByRange(parts, "hkey", "vec_id", "_seq").sortWithinPartitions("hkey", "vec_id", "_seq")
    size = int(min(MOST_ROWS, max(LEAST_ROWS, BLOCK_BYTES // (4 * dim))))
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())),
                        ("n", pa.int32()), ("data", pa.binary()), ("lo", pa.list_(pa.int32())),
                        ("hi", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            e = _matrix(batch.column(2), dim)
            out = []
            for at in range(0, batch.num_rows, size):
                m = e[at:at + size]
                out.append({"block": made, "ids": batch.column(0).slice(at, size).to_pylist(),
                            "labels": batch.column(1).slice(at, size).to_pylist(), "n": len(m),
                            "data": m.tobytes(), "lo": m.min(0).tolist(), "hi": m.max(0).tolist(),
                            "sums": m.astype(np.int64).sum(0).tolist()})
                made += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
    return materialise(sorted_rows.mapInArrow(cut, _BLOCKS), "vector-blocks")


def shortlist(codebook: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Entries (ascending) that may be nearest to some point of the box [lo, hi]."""
    gap = np.maximum(0, np.maximum(lo - codebook, codebook - hi))
    far = np.maximum(np.abs(codebook - lo), np.abs(codebook - hi))
    low, high = (gap * gap).sum(1), (far * far).sum(1)
    return np.flatnonzero(low <= high.min())


def assign_block(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray, codebooks: np.ndarray,
                 totals: np.ndarray | None, counts: np.ndarray | None, rows: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x parts) and errors of one block; adds its sums and counts when asked."""
    n = len(x)
    width = codebooks.shape[2]
    codes = np.zeros((n, PARTS), np.int64)
    error = np.zeros(n, np.int64)
    for p in range(PARTS):
        at = slice(p * width, (p + 1) * width)
        book = codebooks[p]
        short = shortlist(book, lo[at], hi[at])
        if len(short) == 1 and not rows:
            counts[p, short[0]] += n
            totals[p, short[0]] += sums[at]
            continue
        part = x[:, at].astype(np.int64)
        diff = part[:, None, :] - book[short][None, :, :]
        dist = np.einsum("nkl,nkl->nk", diff, diff)
        best = dist.argmin(1)  # first of equal distances: the lower index
        codes[:, p] = short[best]
        error += dist[np.arange(n), best]
        if counts is not None:
            counts[p] += np.bincount(codes[:, p], minlength=len(book))
            for j in range(width):
                totals[p, :, j] += np.bincount(codes[:, p], weights=part[:, j], minlength=len(book)).astype(np.int64)
    return codes, error


def _block(batch: pa.RecordBatch, i: int, dim: int) -> tuple[np.ndarray, ...]:
    row = {k: batch.column(k)[i] for k in ("data", "lo", "hi", "sums")}
    x = np.frombuffer(row["data"].as_py(), np.int32).reshape(-1, dim)
    return (x, np.array(row["lo"].as_py(), np.int64), np.array(row["hi"].as_py(), np.int64),
            np.array(row["sums"].as_py(), np.int64))


def lloyd_round(blocks: DataFrame, codebooks: np.ndarray, dim: int) -> np.ndarray:
    """One assignment and update; unused entries stay."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(codebooks.shape, np.int64)
        counts = np.zeros(codebooks.shape[:2], np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                x, lo, hi, sums = _block(batch, i, dim)
                assign_block(x, lo, hi, sums, codebooks, totals, counts, rows=False)
        p, k = np.nonzero(counts)
        width = codebooks.shape[2]
        yield pa.RecordBatch.from_pydict({
            "part": np.repeat(p, width).astype(np.int32), "entry": np.repeat(k, width).astype(np.int32),
            "pos": np.tile(np.arange(width), len(p)).astype(np.int32),
            "total": totals[p, k].reshape(-1), "n": np.repeat(counts[p, k], width)})
    found = blocks.select("data", "lo", "hi", "sums").mapInArrow(work, _SUMS) \
        .groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    made = codebooks.copy()
    for r in found:  # at most parts x entries x part length rows
        made[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
    return made


def codebook_digest(codebooks: np.ndarray) -> str:
    """sha256 of all components by part, entry, position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.reshape(-1)).encode()).hexdigest()


def encode(embeddings: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) per kept row, and the final codebooks."""
    spark = embeddings.sparkSession
    rows, dim = integer_vectors(embeddings)
    out = "vec_id long, label int, code string, error long"
    if dim == 0:
        return spark.createDataFrame([], out), np.zeros((PARTS, 0, 0), np.int64)
    codebooks = seed_codebook(rows, dim)
    blocks = make_blocks(rows, dim)
    for _ in range(ROUNDS):
        codebooks = lloyd_round(blocks, codebooks, dim)
    final = codebooks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, lo, hi, sums = _block(batch, i, dim)
                codes, error = assign_block(x, lo, hi, sums, final, None, None, rows=True)
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text, pa.string()),
                     pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
    return blocks.select("ids", "labels", "data", "lo", "hi", "sums").mapInArrow(work, out), final


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over equal labels, nulls together."""
    key = F.coalesce(F.col("label").cast("long"), F.lit(-(1 << 40)))  # null labels as one group
    sums = coded.groupBy(key.alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.withColumn("_label", key).join(scale.bounded(sums), "_label").drop("_label")
