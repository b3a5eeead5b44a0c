"""SentencePiece encoding and decoding over distinct chunks.

Where no vocabulary piece crosses a white-space marker, the ids of a text are the
ids of its marked words one after another. Each block of rows keeps a table of its
distinct marked words, every one is segmented once, and ids are joined back by
position. Tables are task-local: nothing is shuffled or broadcast.

Edge cases: null and empty texts give the end id alone and decode to the empty text;
white space is kept as it is; repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .bpe_count import PieceVocabulary, merge, vocabulary

#: Distinct chunks a worker's table holds at most; a full table is emptied.
MEMORY = 1_200_000


def encode_chunk(chunk: str, model: PieceVocabulary) -> list[int]:
    """Ids of a chunk that no longer piece crosses into or out of."""
    parts = [p for p in merge(chunk, model.rank)[0] if p] if len(chunk) > 1 else [chunk]
    try:
        return [model.ids[p] for p in parts]
    except KeyError:
        ids: list[int] = []
    for part in parts:  # some character is outside the vocabulary
        if part in model.ids:
            ids.append(model.ids[part])
        elif model.byte_ids:
            ids.extend(model.byte_ids[b] for b in part.encode())
        else:
            ids.append(model.unknown)
    return ids


def decode_ids(ids: list[int], model: PieceVocabulary) -> str:
    """Text of ids: bytes are gathered into characters, markers become spaces."""
    if model.byte_of.keys().isdisjoint(ids):
        return "".join(map(model.forms.__getitem__, ids))
    out, pending = [], bytearray()
    for i in ids:
        if i in model.byte_of:
            pending.append(model.byte_of[i])
            continue
        if pending:
            out.append(pending.decode("utf-8", "replace"))
            pending.clear()
        out.append(model.forms[i])
    return "".join(out) + pending.decode("utf-8", "replace")


class ChunkTable:
    """Distinct marked words with their ids (int32 each), and decoded forms where those differ from the word."""

    def __init__(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.forms: dict[str, str] = {}

    def clear(self) -> None:
        self.ids.clear()
        self.forms.clear()

    def _segment(self, chunk: str, model: PieceVocabulary) -> bytes:
        ids = encode_chunk(chunk, model)
        form = decode_ids(ids, model)
        if form != chunk:
            self.forms[chunk] = form
        found = self.ids[chunk] = array("i", ids).tobytes()
        return found

    def add(self, chunks: set[str], model: PieceVocabulary) -> None:
        """Segment the chunks that are new; a chunk of parts is joined from its distinct parts."""
        get = self.ids.get
        for chunk in chunks.difference(self.ids):
            parts = model.split(chunk)
            found = [get(p) or self._segment(p, model) for p in parts]
            if len(parts) > 1:
                self.ids[chunk] = b"".join(found)
                if not self.forms.keys().isdisjoint(parts):
                    self.forms[chunk] = "".join(self.forms.get(p, p) for p in parts)

    def decoded(self, chunks: list[str]) -> str:
        if self.forms.keys().isdisjoint(chunks):
            return "".join(chunks)
        return "".join(self.forms.get(c, c) for c in chunks)


_tables: dict[str, ChunkTable] = {}


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) with the model at ``path``, an end id last."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = vocabulary(path)
        table = _tables.setdefault(path, ChunkTable())
        end = array("i", [model.end]).tobytes()
        offsets, rows, decoded = np.zeros(batch.num_rows + 1, np.int32), [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            chunks = model.chunks(text) if text else []
            table.add(set(chunks), model)
            rows.append(b"".join(map(table.ids.__getitem__, chunks)) + end)
            offsets[row + 1] = offsets[row] + len(rows[-1]) // 4
            # the marker put before the text goes, as the library's decoder has it
            decoded.append(table.decoded(chunks)[1:])
            if len(table.ids) > MEMORY:
                table.clear()
        flat = pa.array(np.frombuffer(b"".join(rows), np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.string())],
            ["doc_id", "ids", "decoded"])
    kind = dict(docs.dtypes)["doc_id"]
    return B.map_text(docs.select("doc_id", "text"), work, f"doc_id {kind}, ids array<int>, decoded string")
