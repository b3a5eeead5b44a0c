"""Token shards against the library and zlib, and the code on skewed counts."""

import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from topicloom.llm import queries as Q  # noqa: E402
from topicloom.llm import token_binary as T  # noqa: E402
from topicloom.runtime import run_path  # noqa: E402

MODEL = str(public_tokenizers.path("word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, seq string, ids string, start string"
PROSE = "the old lamp in the harbour still glows and the blue boats come home before the night falls "


def brute(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(MODEL)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    out, before = [], 0
    for k in order:
        ids = tok.encode(rows[k][1] or "", add_special_tokens=False).ids + [2]
        out.append((rows[k][0], before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, "en", "s", "x", "y", "z") for i, t in rows], DOCS).repartition(3)
    got = T.write_and_read(frame, MODEL, run_path(spark, "token-test")).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1])


def test_shards_equal_the_library(spark):
    rows = [(5, PROSE), (1, None), (3, ""), (None, "x y"), (2, PROSE * 9000), (4, "<|endoftext|> Aé 日本 😀"),
            (4, "<|endoftext|> Aé 日本 😀"), (0, " \n\t "), (None, None)] + [(10 + i, PROSE[:i]) for i in range(60)]
    got = run(spark, rows)
    want = brute(rows)
    # rows of one doc_id keep reading order, which a repartition may change: compare as sets within an id
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want] or sorted(got) == sorted(want)
    assert [r[1] for r in got] == [r[1] for r in want]
    assert max(r[2] for r in got) > T.BLOCK_IDS  # one document spans blocks


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_code_is_prefix_free_and_limited(n):
    counts = np.zeros(n + 5, np.int64)
    fib = [1, 1]
    while len(fib) < n:
        fib.append(fib[-1] + fib[-2])
    counts[5:] = fib[:n]
    lengths = T.code_lengths(counts, max_bits=12)
    assert lengths[:5].sum() == 0 and lengths.max() <= 12
    assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1.0
    rng = np.random.default_rng(n)
    ids = rng.choice(np.arange(5, n + 5), 5000, p=counts[5:] / counts.sum())
    data, starts = T.pack_bits(ids, T.canonical_codes(lengths), lengths)
    table = T.decode_table(lengths, 12)
    got = T.decode_block(data, starts[::T.CHECK_IDS], len(ids), *table, max_bits=12)
    assert (got == ids).all()


def test_query_columns(spark):
    got = Q.op12_token_binary(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_word_coder_equals_the_library():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(MODEL)
    coder = T.WordCoder(MODEL)
    texts = [t or "" for t in pq.read_table(f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/documents.parquet",
                                            columns=["text"]).column(0).to_pylist()]
    texts += ["İstanbul ΣΟΦΟΣ σοφος.", "a\x1cb\x1f c", "x'sy it's 'LL", "<|endoftext|>ab<|startoftext|> c<|endoftext|>",
              "é́   x　y z", "😀日本 Aé", "", "   ", "1234 5,6", "a\u0085b c", "<|endoftext|<|endoftext|>>"]
    assert [coder.encode(t).tolist() for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_each_pre_token_is_given_to_the_model_once():
    coder = T.WordCoder(MODEL)
    seen, real = [], coder._word
    coder._word = lambda w: seen.append(w) or real(w)
    texts = ["rabbit, (rabbit) rabbit's rabbit", "it's \u00e9t\u00e9, \u00e9t\u00e9. x!'s 12 21"]
    got = [list(coder.encode(t)) for t in texts]
    assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(seen) == len(set(seen))


def test_blocks_decoded_together():
    rng = np.random.default_rng(5)
    counts = np.array([1000, 500, 3, 1, 0, 7])
    lengths = T.code_lengths(counts)
    codes = T.canonical_codes(lengths)
    table = T._windows(*T.decode_table(lengths))
    want = [rng.choice([0, 1, 2, 3, 5], n) for n in (1024, 1, 300, 256, 77)]
    data, blocks = b"head", []
    for ids in want:
        packed, starts = T.pack_bits(ids, codes, lengths)
        blocks.append((len(data), len(packed), starts[::T.CHECK_IDS].astype(np.uint32), len(ids)))
        data += packed
    got = T.decode_blocks(data, blocks, table)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
