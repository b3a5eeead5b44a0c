"""Token ids in binary shards: canonical length-limited Huffman codes from global counts.

Method. Texts are encoded as a ``tokenizers`` file does (each distinct white-space chunk
once per worker, see :class:`WordCoder`) in bounded blocks and the end id is appended;
the id rows are written once to the shared folder. Every task counts its
ids (``bincount``) and Spark adds the counts: the driver receives one row per used id,
bounded by the vocabulary. Huffman code lengths are made from the counts, cut to
``MAX_BITS`` by moving leaves down (the adjustment of JPEG, annex K), and canonical
codes follow from the lengths alone. Documents are range-partitioned by (doc_id,
order of reading), sorted, and each partition writes one shard in ascending doc_id
order: blocks of at most ``BLOCK_IDS`` ids, each byte-aligned and independent, with the
bit offset of every ``CHECK_IDS``-th id inside it; then the block table, the documents
(id, length) and a trailer. Files are written under a temporary name and renamed when
whole; the manifest rows name them and Spark's commit makes them visible. Reading
decodes all checkpoint segments of a block group in lockstep with one look-up table of
``2 ** MAX_BITS`` entries (a numpy gather per step, no per-id Python), and a document's
crc32 is chained over the blocks it spans.

Contract (``op12``): a null text is empty and gives only the end id; ids are written in
ascending doc_id order (nulls last, rows of one doc_id in reading order); ``start`` counts
the ids of all documents before it, ``ids_crc32`` is the unsigned crc32 of its ids as
little-endian uint32. Repeated rows are written each time. An empty table gives an
empty manifest and no rows. Other input columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, open_fs, ship
from . import blocks as B

END_ID = 2
MAX_BITS = 20
BLOCK_IDS, CHECK_IDS = 1 << 16, 256
#: Blocks decoded together.
GROUP_BLOCKS = 16
#: Bytes of ids (as uint16 would be) per shard; at least one shard per core.
SHARD_IDS = 16 << 20
MAGIC = b"TOKHUF01"
_IDS = "doc_id long, seq long, n long, ids binary"
_MANIFEST = "file string, shard int, docs long, ids long, bytes long, sha256 string"

# The split pattern of the word BPE file's pre-tokenizer (its \s is Unicode
# White_Space) and the bytes that Python's str.split() takes for white space beyond it.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
NOT_WHITE = "\x1c\x1d\x1e\x1f"
#: Distinct chunks and pre-tokens a worker keeps before it empties its table (which changes no result).
CHUNKS = 500_000
_ID = attrgetter("id")


class WordCoder:
    """Ids of texts as the tokenizers file gives them, each distinct chunk encoded once.

    The file normalises (NFC, white-space runs to one space, lower case per character)
    and splits into pre-tokens that never hold white space; its special strings are cut
    out of the raw text first. So a text's ids are the ids of its special strings and of
    its white-space separated chunks, in order; a chunk is split into pre-tokens by the
    same pattern and each distinct pre-token (as byte-level characters) goes to the file's model once.
    Tests hold the result equal to ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.special = {t.content: i for i, t in added}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) \
            if self.special else None
        self.words = regex.compile(PRE_TOKENS)
        self.white = regex.compile(r"\p{White_Space}+")
        bs = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
        extra = [b for b in range(256) if b not in bs]
        chars = {b: chr(b) for b in bs} | {b: chr(256 + i) for i, b in enumerate(extra)}
        self.byte_chars = str.maketrans({chr(b): c for b, c in chars.items()})  # latin-1 view of the bytes
        self.chunks: dict[str, array] = {}

    def _miss(self, chunk: str) -> array:
        if len(self.chunks) >= CHUNKS:
            self.chunks.clear()
        words = [chunk] if chunk.isascii() and chunk.isalpha() else self.words.findall(chunk)
        if len(words) == 1:
            found = self._word(words[0])
        else:  # a pre-token alone is split into itself, so it has its place in the same table
            found = array("i")
            for w in words:
                ids = self.chunks.get(w)
                if ids is None:
                    ids = self.chunks[w] = self._word(w)
                found.extend(ids)
        self.chunks[chunk] = found
        return found

    def _word(self, word: str) -> array:
        """Ids of one pre-token from the file's model."""
        if not (word.isascii() and word.isalpha()):
            word = word.encode().decode("latin-1").translate(self.byte_chars)
        return array("i", map(_ID, self.model.tokenize(word)))

    def _parts(self, text: str) -> list[str]:
        """White-space separated chunks of the normalised text."""
        import unicodedata
        text = unicodedata.normalize("NFC", text)
        if any(c in text for c in NOT_WHITE):
            return [p for p in self.white.sub(" ", text).replace("\u03a3", "\u03c3").lower().split(" ") if p]
        return text.replace("\u03a3", "\u03c3").lower().split()

    def _plain(self, parts: list[str], out: array) -> None:
        get, miss, extend = self.chunks.get, self._miss, out.extend
        for chunk in parts:
            found = get(chunk)
            extend(found if found is not None else miss(chunk))

    def encode_many(self, texts: list[str], out: array, ends: array, end_id: int) -> None:
        """Ids of many texts, each closed by ``end_id``; ``ends`` gets the running lengths."""
        for ps in map(self._pieces, texts):
            for k, p in enumerate(ps):
                if k % 2:
                    out.append(p)
                else:
                    self._plain(p, out)
            out.append(end_id)
            ends.append(len(out))

    def _pieces(self, text: str) -> list:
        """Chunk lists of the plain parts of ``text`` with the special ids between them."""
        made, at = [], 0
        for m in (self.cut.finditer(text) if self.cut else ()):
            made += [self._parts(text[at:m.start()]), self.special[m.group()]]
            at = m.end()
        return made + [self._parts(text[at:])]

    def forget(self) -> None:
        """Empty the table of chunks (at the end of a task: workers live on into other stages)."""
        self.chunks = {}

    def encode(self, text: str) -> array:
        """Ids of ``text``."""
        out = array("i")
        self.encode_many([text], out, array("i"), -1)
        return out[:-1]


_coders: dict[str, WordCoder] = {}


def _coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def id_type(model: str) -> np.dtype:
    """Little-endian unsigned integers wide enough for every id of the file."""
    size = _coder(model).tokenizer.get_vocab_size(with_added_tokens=True)
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def ids_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids per row) of a binary column of packed ids."""
    if len(column) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind).astype(np.int64), np.diff(bounds) // kind.itemsize


def encode_ids(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, seq, n, ids): ids of every text with the end id, packed as ``id_type``, written once."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("seq"),
                            F.col("text").cast("string").alias("text"))
    kind = id_type(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        try:
            for batch in B.blocks(batches, "text"):
                offsets, flat = array("i", [0]), array("i")
                coder.encode_many([t or "" for t in batch.column(2).to_pylist()], flat, offsets, END_ID)
                ends = np.frombuffer(offsets, np.int32)
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [
                    None, pa.py_buffer((ends * kind.itemsize).astype(np.int32).tobytes()),
                    pa.py_buffer(np.frombuffer(flat, np.int32).astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)),
                                                  packed], names=["doc_id", "seq", "n", "ids"])
        finally:
            coder.forget()
    ship(documents.sparkSession)
    return materialise(rows.mapInArrow(work, _IDS), "token-ids")


def id_counts(coded: DataFrame, kind: np.dtype) -> np.ndarray:
    """Count of every id over all documents (length: largest id + 1)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            flat, _ = ids_of(batch.column(0), kind)
            if len(flat):
                found = np.bincount(flat)
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[:len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])
    rows = coded.select("ids").mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)  # one row per used id
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Huffman code lengths of the used ids, none above ``max_bits``; 0 for unused ids."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes of the longest length")
    heap = [(int(counts[s]), int(s), -1, -1) for s in used]  # (weight, tie, left, right)
    heapq.heapify(heap)
    nodes: list[tuple[int, int]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        nodes.append((a[1], b[1]))
        heapq.heappush(heap, (a[0] + b[0], len(counts) + len(nodes) - 1, a[1], b[1]))
    depth = {heap[0][1]: 0}
    for at in range(len(nodes) - 1, -1, -1):  # parents before children
        left, right = nodes[at]
        d = depth[len(counts) + at] + 1
        depth[left] = depth[right] = d
    deep = np.array([depth[int(s)] for s in used], np.int64)
    per_length = np.bincount(deep, minlength=max(max_bits, int(deep.max())) + 1)
    for i in range(len(per_length) - 1, max_bits, -1):  # move leaves up until nothing is deeper than max_bits
        while per_length[i] > 0:
            j = i - 2
            while per_length[j] == 0:
                j -= 1
            per_length[i] -= 2
            per_length[i - 1] += 1
            per_length[j + 1] += 2
            per_length[j] -= 1
    # the most frequent ids get the shortest lengths, ties by id
    order = used[np.lexsort((used, -counts[used]))]
    lengths[order] = np.repeat(np.arange(len(per_length)), per_length)[:len(order)]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes of the canonical Huffman code of ``lengths``: ordered by (length, id)."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    for s in order:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every ``max_bits``-bit window, by its leading code."""
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    spans = 1 << (max_bits - lengths[used])
    ids = np.zeros(1 << max_bits, np.int32)
    sizes = np.zeros(1 << max_bits, np.int8)
    starts = codes[used] << (max_bits - lengths[used])
    at = np.repeat(starts - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
    ids[at] = np.repeat(used, spans)
    sizes[at] = np.repeat(lengths[used], spans)
    return ids, sizes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the codes of ``ids``, and the bit offset of each id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ends) else 0
    # a code lies in the 64 bits from the 32-bit word it starts in; codes share no bit, so sums join them (exact in a double)
    word = starts >> 5
    wide = codes[ids] << (64 - size - (starts & 31))
    length = (total >> 5) + 2
    words = np.bincount(word, (wide >> 32) & 0xFFFFFFFF, length) + np.bincount(word + 1, wide & 0xFFFFFFFF, length)
    return words.astype(">u4").tobytes()[:-(-total // 8)], starts


def decode_blocks(data: bytes, blocks: list[tuple[int, int, np.ndarray, int]], table: np.ndarray,
                  max_bits: int = MAX_BITS) -> list[np.ndarray]:
    """The ids of some blocks (offset in ``data``, bytes, checkpoints, number), all checkpoint segments in lockstep.

    ``table`` has ``id << 8 | length`` per window. A segment that ends early reads on; what it reads is cut off.
    """
    low, high = blocks[0][0], blocks[-1][0] + blocks[-1][1]
    stream = np.frombuffer(data[low:high] + b"\0" * (CHECK_IDS * max_bits // 8 + 8), np.uint8).astype(np.uint32)
    words = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]  # 32 bits from each byte
    pos = np.concatenate([(offset - low) * 8 + checks.astype(np.int64) for offset, _, checks, _ in blocks])
    out = np.zeros((CHECK_IDS, len(pos)), np.int32)
    rest = np.uint32(32 - max_bits)
    for k in range(min(CHECK_IDS, max(b[3] for b in blocks))):
        found = table[(words[pos >> 3] << (pos & 7).astype(np.uint32)) >> rest]
        out[k] = found >> 8
        pos += found & 255
    flat, at, made = out.T.reshape(-1), 0, []
    for _, _, checks, n in blocks:
        made.append(flat[at:at + n])
        at += len(checks) * CHECK_IDS
    return made


def decode_block(data: bytes, checks: np.ndarray, n: int, ids: np.ndarray, sizes: np.ndarray,
                 max_bits: int = MAX_BITS) -> np.ndarray:
    """The ``n`` ids of one block."""
    return decode_blocks(data, [(0, len(data), checks, n)], _windows(ids, sizes), max_bits)[0] if n else np.zeros(0, np.int32)


def _windows(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``id << 8 | length`` per window of :func:`decode_table`."""
    return (ids.astype(np.int64) << 8) | sizes


def write_shards(coded: DataFrame, path: str, lengths: np.ndarray, kind: np.dtype) -> DataFrame:
    """Shards of ``coded`` under ``path`` (a new shared folder) in ascending doc_id order; the manifest."""
    spark = coded.sparkSession
    ship(spark)
    files, root = open_fs(path)
    files.create_dir(root, recursive=True)
    total = int(coded.select(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    shards = int(max(spark.sparkContext.defaultParallelism, -(-total * 2 // SHARD_IDS)))
    order = [F.col("doc_id").asc_nulls_last(), F.col("seq").asc()]
    dealt = coded.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    codes = canonical_codes(lengths)
    table = zlib.compress(lengths.astype(np.uint8).tobytes())
    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()),
                        ("bytes", pa.int64()), ("sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        fs, base = open_fs(path)
        name = f"part-{shard:05d}.tok"
        temporary = f"{base}/_temporary-{name}-{attempt}"
        digest, written = hashlib.sha256(), 0
        out = fs.open_output_stream(temporary, compression=None)

        def put(data: bytes) -> None:
            nonlocal written
            out.write(data)
            digest.update(data)
            written += len(data)
        put(MAGIC + struct.pack("<II", MAX_BITS, len(table)) + table)
        doc_ids, nulls, sizes, index = [], [], [], []
        pending: list[np.ndarray] = []
        held = 0

        def flush(final: bool) -> None:
            nonlocal pending, held
            flat = np.concatenate(pending) if pending else np.zeros(0, np.int32)
            while len(flat) >= BLOCK_IDS or (final and len(flat)):
                part, flat = flat[:BLOCK_IDS], flat[BLOCK_IDS:]
                data, starts = pack_bits(part.astype(np.int64), codes, lengths)
                checks = starts[::CHECK_IDS].astype(np.uint32)
                index.append(struct.pack("<QQII", written, len(data), len(part), len(checks)) + checks.tobytes())
                put(data)
            pending, held = [flat], len(flat)
        for batch in batches:
            flat_ids, per_row = ids_of(batch.column(batch.schema.get_field_index("ids")), kind)
            doc_ids.extend(batch.column(0).to_pylist())
            sizes.append(per_row)
            pending.append(flat_ids.astype(np.int32))
            held += len(pending[-1])
            if held >= BLOCK_IDS:
                flush(False)
        flush(True)
        at_index = written
        put(struct.pack("<I", len(index)) + b"".join(index))
        at_docs = written
        nulls = np.array([d is None for d in doc_ids], np.uint8)
        lengths_of_docs = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        put(struct.pack("<Q", len(doc_ids)) + np.array([d or 0 for d in doc_ids], np.int64).tobytes() + nulls.tobytes()
            + lengths_of_docs.tobytes())
        put(struct.pack("<QQ", at_index, at_docs) + MAGIC)
        out.close()
        fs.move(temporary, f"{base}/{name}")
        yield pa.RecordBatch.from_pylist([{"file": name, "shard": shard, "docs": len(doc_ids),
                                           "ids": int(lengths_of_docs.sum()), "bytes": written,
                                           "sha256": digest.hexdigest()}], schema)
    dealt.mapInArrow(work, _MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the shards the manifest names."""
    ship(spark)
    manifest = sorted(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("file", "shard", "ids").collect(),
                      key=lambda r: r["shard"])  # one row per shard
    before, offsets = 0, []
    for r in manifest:
        offsets.append((r["file"], before))
        before += r["ids"]
    names = spark.createDataFrame(offsets or [], "file string, before long")
    spread = names.repartition(max(1, min(len(offsets), 10_000)), "file")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield read_one(fs, f"{base}/{name}", start)
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_one(fs, name: str, start: int) -> pa.RecordBatch:
    """Documents of one shard; ``start`` is the number of ids before it."""
    with fs.open_input_file(name) as f:
        data = f.read()
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError(f"{name} is not a whole shard")
    max_bits, size = struct.unpack_from("<II", data, 8)
    lengths = np.frombuffer(zlib.decompress(data[16:16 + size]), np.uint8).astype(np.int64)
    table = _windows(*decode_table(lengths, max_bits))
    at_index, at_docs = struct.unpack_from("<QQ", data, len(data) - 24)
    (n_docs,) = struct.unpack_from("<Q", data, at_docs)
    doc_ids = np.frombuffer(data, np.int64, n_docs, at_docs + 8)
    nulls = np.frombuffer(data, np.uint8, n_docs, at_docs + 8 + 8 * n_docs).astype(bool)
    doc_sizes = np.frombuffer(data, np.int64, n_docs, at_docs + 8 + 9 * n_docs)
    (n_blocks,) = struct.unpack_from("<I", data, at_index)
    at = at_index + 4
    crcs = np.zeros(n_docs, np.int64)
    doc, inside, crc = 0, 0, 0
    blocks = []
    for _ in range(n_blocks):
        offset, nbytes, n, nchecks = struct.unpack_from("<QQII", data, at)
        blocks.append((offset, nbytes, np.frombuffer(data, np.uint32, nchecks, at + 24), n))
        at += 24 + 4 * nchecks
    decoded = (ids for g in range(0, n_blocks, GROUP_BLOCKS)
               for ids in decode_blocks(data, blocks[g:g + GROUP_BLOCKS], table, max_bits))
    for block in decoded:
        block, n = block.astype("<u4"), len(block)
        used = 0
        while used < n:  # documents within or across this block
            take = min(int(doc_sizes[doc]) - inside, n - used)
            crc = zlib.crc32(block[used:used + take].tobytes(), crc)
            used += take
            inside += take
            if inside == doc_sizes[doc]:
                crcs[doc], doc, inside, crc = crc, doc + 1, 0, 0
    before = start + np.concatenate([[0], np.cumsum(doc_sizes)[:-1]]).astype(np.int64) if n_docs else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(before, pa.int64()), pa.array(doc_sizes, pa.int64()),
         pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_and_read(documents: DataFrame, model: str, path: str) -> DataFrame:
    """Encode, count, code, write the shards under ``path`` and read them back."""
    coded = encode_ids(documents, model)
    kind = id_type(model)
    lengths = code_lengths(id_counts(coded, kind))
    write_shards(coded, path, lengths, kind)
    return read_shards(documents.sparkSession, path)
