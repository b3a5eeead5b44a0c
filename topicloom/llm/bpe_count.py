"""Token counts by byte-pair merging with a heap and a linked list.

The pair of lowest rank is popped again and again and merged in a doubly linked
list. A text's count is its initial symbols minus the merges; no ids are made.

Merges cannot cross a place that no vocabulary piece spans: texts are cut before
white space, around characters that are in no longer piece, and between two
characters that stand side by side in no piece. Each distinct chunk is merged once
per worker memory. The memory is bounded and emptied when full, which changes no
result.

Edge cases: null and empty texts have no tokens; characters outside the vocabulary
count as their UTF-8 bytes; repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SPACE = "▁"
#: Distinct chunks a task remembers at once.
MEMORY = 2_000_000
#: Documents with more tokens than this are over the limit.
LIMIT = 4096


class PieceVocabulary:
    """Ranks, bytes and cut places of a sentencepiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        plain = [i for i in range(size) if not special[i] and not byte[i]]
        # inside, the white-space marker is a space, as most texts have it
        forms = {i: self.pieces[i].replace(SPACE, " ") for i in plain}
        self.ids = {forms[i]: i for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if byte[i]}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.special = {i for i in range(size) if special[i]}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        #: What each id decodes to by itself; bytes are put together by the decoder.
        self.forms = ["" if special[i] else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.forms[self.unknown] = " ⁇ "
        # the piece of the highest score is merged first; equal scores keep one rank
        levels = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.rank = {forms[i]: levels[model.get_score(i)] for i in plain if len(forms[i]) > 1}
        self.neighbours = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        crossing = any(" " in p.lstrip(" ") for p in self.rank)
        inner = "".join(re.escape(c) for c in sorted({c for p in self.rank for c in p} - {" "}))
        if crossing:  # pieces span white space
            self.cut = re.compile(f"[{inner} ]+|.", re.DOTALL)
        else:
            self.cut = re.compile(f" +[{inner}]*|[{inner}]+|." if inner else ".", re.DOTALL)

    def chunks(self, text: str) -> list[str]:
        """A text behind its first marker, cut where no piece can span."""
        return self.cut.findall(" " + text.replace(SPACE, " ")) if text else []

    def split(self, chunk: str) -> list[str]:
        """A chunk cut between characters that stand side by side in no piece."""
        near = self.neighbours
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1:i + 1] not in near]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)] if cuts else [chunk]

    def symbols(self, char: str) -> int:
        """Tokens of one character left by itself."""
        return 1 if char in self.ids or not self.byte_ids else len(char.encode())


def merge(chunk: str, rank: dict[str, int]) -> tuple[list[str], int]:
    """(symbols with merged-away ones empty, number of merges).

    A heap entry is one number: rank of the pair, then place of its left symbol.
    ``live`` has each place's present entry; any other entry of it is stale.
    """
    n, merges = len(chunk), 0
    width = n.bit_length()
    mask = (1 << width) - 1
    # one place more than symbols: -1 as a place is the same end of the list
    parts, after, before = [*chunk, ""], list(range(1, n + 2)), list(range(-1, n))
    get, none = rank.get, 1 << 62
    live = [get(a + b, none) << width | i for i, (a, b) in enumerate(zip(chunk, chunk[1:], strict=False))]
    live += [none, none]
    heap = [x for x in live if x < none]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & mask
        if live[i] != entry:
            continue
        j = after[i]
        whole = parts[i] = parts[i] + parts[j]
        parts[j], live[j] = "", none
        merges += 1
        k = after[i] = after[j]
        before[k] = i
        entry = live[i] = none if k == n else get(whole + parts[k], none) << width | i
        if entry < none:
            heappush(heap, entry)
        h = before[i]
        if h >= 0:
            entry = live[h] = get(parts[h] + whole, none) << width | h
            if entry < none:
                heappush(heap, entry)
    return parts[:n], merges


def count_chunk(chunk: str, vocabulary: PieceVocabulary, known: dict[str, int]) -> int:
    """Initial symbols minus merges; a character that stays outside the vocabulary weighs its bytes."""
    total = 0
    for piece in vocabulary.split(chunk):
        found = known.get(piece)
        if found is None:
            parts, merges = merge(piece, vocabulary.rank)
            found = len(piece) - merges
            if not vocabulary.ids.keys() >= set(piece):
                found += sum(vocabulary.symbols(c) - 1 for c in parts if len(c) == 1)
            known[piece] = found
        total += found
    known[chunk] = total
    return total


_loaded: dict[str, PieceVocabulary] = {}
_counted: dict[str, dict[str, int]] = {}


def vocabulary(path: str) -> PieceVocabulary:
    """The model at ``path``, read once per worker."""
    if path not in _loaded:
        _loaded[path] = PieceVocabulary(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) by the sentencepiece BPE model at ``path``.

    ``path`` must exist on every worker. One narrow pass, nothing is shuffled.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = vocabulary(path)
        known = _counted.setdefault(path, {})
        totals = []
        for text in batch.column(1).to_pylist():
            chunks = model.chunks(text) if text else []
            for chunk in set(chunks).difference(known):
                count_chunk(chunk, model, known)
            totals.append(sum(map(known.__getitem__, chunks)))
            if len(known) > MEMORY:
                known.clear()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], ["doc_id", "n_tokens"]) \
            .append_column("n_bytes", pa.array(_lengths(batch.column(1)), pa.int64()))
    kind = dict(docs.dtypes)["doc_id"]
    made = B.map_text(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_tokens long, n_bytes long")
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _lengths(column: pa.Array):
    _, bounds = B.text_bytes(column)
    return bounds[1:] - bounds[:-1]
