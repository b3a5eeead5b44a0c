"""Deterministic sharded WARC writer and reader.

Records are dealt into shards by ranges of the page id. The bounds come from the ids of
smallest hash, so the same pages give the same shards whatever the order or number of
tasks. A task sorts its shards, writes one gzip member per record and rolls to the next
file by compressed size. Headers, record ids and digests are made anew from the rows.
Files are written under a temporary name and renamed when whole; the rows that name
them are the manifest, which Spark's own commit makes visible at once. Readers open
only files that the manifest names. A task that runs again writes the same bytes.

Of records with equal payloads of at least ``REVISIT_BYTES`` that of the largest page id
is the response; the others are revisits of it.

Edge cases: a null payload is empty; a null url becomes ``urn:page:ID``; rows without
an id are responses; rows that repeat the largest id of their payload are responses
too; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scale
from ..runtime import materialise, open_fs, ship

REVISIT_BYTES = 1000
#: Compressed size from which a file is closed.
ROLL_BYTES = 64 << 20
SHARD_BYTES = 256 << 20
LEAST_SHARDS, MOST_SHARDS = 32, 16_384
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_MANIFEST = "file string, shard int, seq int, records long, bytes long, sha256 string"


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): sha1 digests, and the response of each revisit."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")) \
        .withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    many = materialise(rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
                       .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"),
                       "equal-payloads")
    return rows.join(scale.bounded(many), ["digest", "size"], "left").select(
        "page_id", "url", "payload", "digest", "size",
        F.when(F.col("_first") != F.col("page_id"), F.col("_first")).alias("refers_to"))


def with_shards(rows: DataFrame, pages: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with their shard, and how many shards there are."""
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html") + 512), F.lit(0)).alias("n")).first()["n"]
    shards = int(min(MOST_SHARDS, max(LEAST_SHARDS, -(-total // SHARD_BYTES))))
    # a bounded sample that does not depend on the order of rows
    sample = pages.filter("page_id is not null").select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")) \
        .orderBy(F.xxhash64("page_id"), "page_id").limit(max(8192, 4 * shards)).toArrow().to_pandas().sort_values("page_id")
    cuts: list[float] = []
    if len(sample):
        weight = np.cumsum(sample["n"].to_numpy() + 512.0)
        at = np.searchsorted(weight, weight[-1] * np.arange(1, shards) / shards)
        cuts = sorted({float(x) for x in sample["page_id"].to_numpy()[at]})
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_id", outputCol="_shard", handleInvalid="keep").transform(
        rows.withColumn("_id", F.coalesce(F.col("page_id").cast("double"), F.lit(float("-inf")))))
    return dealt.withColumn("shard", F.col("_shard").cast("int")).drop("_id", "_shard"), len(splits)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(data).decode()


def record_id(page: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{digest.hex()}')}>"


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: bytes, refers: int | None,
                 date: str = DATE) -> bytes:
    """One WARC record: a whole HTTP response, or a revisit with its header only."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers is not None else http + payload
    target = "".join(f"%{b:02X}" if b <= 32 or b >= 127 else chr(b) for b in url.encode()) if url else f"urn:page:{page}"
    head = [("WARC-Type", "revisit" if refers is not None else "response"), ("WARC-Record-ID", record_id(page, digest)),
            ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", _sha1(digest)),
            ("WARC-Block-Digest", _sha1(hashlib.sha1(block).digest()))]
    if page is not None:
        head.append(("X-Page-ID", str(page)))
    if refers is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page", str(refers))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMES, name)}>\r\n"
            f"WARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\n"
            f"Content-Length: {len(block)}\r\n\r\n")
    return head.encode() + block + b"\r\n\r\n"


class _Files:
    """Files of one shard, one after another, each renamed when it is whole."""

    def __init__(self, path: str, shard: int, attempt: int, roll: int, date: str):
        self.fs, self.root = open_fs(path)
        self.shard, self.attempt, self.roll, self.date = shard, attempt, roll, date
        self.seq, self.out = -1, None

    def _member(self, record: bytes) -> None:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time
        data = press.compress(record) + press.flush()
        self.out.write(data)
        self.sum.update(data)
        self.bytes += len(data)

    def write(self, record: bytes) -> dict | None:
        """Write one record; gives the manifest row of a file that this filled."""
        if self.out is None:
            self.seq += 1
            self.name = f"part-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{self.name}-{self.attempt}"
            self.out, self.sum, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
            self._member(_info(self.name, self.date))
        self._member(record)
        self.records += 1
        return self.close() if self.bytes >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        return {"file": self.name, "shard": self.shard, "seq": self.seq, "records": self.records, "bytes": self.bytes,
                "sha256": self.sum.hexdigest()}


def write_archives(pages: DataFrame, path: str, roll: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``path``, a new shared folder; returns the manifest."""
    spark = pages.sparkSession
    ship(spark)
    files, root = open_fs(path)
    files.create_dir(root, recursive=True)
    rows, shards = with_shards(with_revisits(pages), pages)
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "url")
    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()),
                        ("bytes", pa.int64()), ("sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, now, made = TaskContext.get().taskAttemptId(), None, []
        for batch in batches:
            for row in _rows(batch):
                if now is None or now.shard != row["shard"]:
                    made.append(now.close() if now else None)
                    now = _Files(path, row["shard"], attempt, roll, date)
                made.append(now.write(record_bytes(row["page_id"], row["url"], row["payload"], row["digest"],
                                                   row["refers_to"], date)))
        made.append(now.close() if now else None)
        yield pa.RecordBatch.from_pylist([m for m in made if m], schema)
    dealt.select("shard", "page_id", "url", "payload", "digest", "refers_to").mapInArrow(work, _MANIFEST) \
        .write.parquet(f"{path}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def _rows(batch: pa.RecordBatch, step: int = 64) -> Iterator[dict]:
    for at in range(0, batch.num_rows, step):  # few rows at a time as Python objects
        yield from batch.slice(at, step).to_pylist()


def _members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """Unpacked gzip members of a stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    data = stream.read(step)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data or stream.read(step), zlib.decompressobj(31), []
        else:
            data = stream.read(step)
    if parts:
        raise ValueError("the archive ends inside a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record's length is wrong")
    return headers, block


def _read_page(record: bytes) -> dict | None:
    headers, block = parse_record(record)
    if headers["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    if _sha1(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"]:
        raise ValueError("a block does not have its digest")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError("a payload does not have its length and digest")
    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
    return {"page_id": None if page is None else int(page), "url": headers["WARC-Target-URI"],
            "payload_bytes": size, "payload_digest": digest.hex(), "record_type": headers["WARC-Type"],
            "refers_to": None if refers is None else int(refers), "payload": None if revisit else payload}


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Pages of the archives that the manifest under ``path`` names; digests are checked."""
    ship(spark)
    names = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("file")
    spread = names.repartition(int(min(max(names.count(), 1), 10_000)), "file")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema = pa.schema([*fields, ("payload", pa.binary())] if payload else fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, root = open_fs(path)
                rows, size = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        page = _read_page(record)
                        if page:
                            rows.append({k: page[k] for k in schema.names})
                            size += len(record) if payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
    return spread.mapInArrow(work, kinds + (", payload binary" if payload else ""))
