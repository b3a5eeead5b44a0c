"""Operators against plain restatements of their rules, and on odd rows."""

import base64
import json
import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from compare import database, difference  # noqa: E402
from topicloom.llm import bpe_count, context_tree, decontaminate, host_rules, language, oracles, pieces  # noqa: E402
from topicloom.llm import prob_minhash, quality_gam, secret_scan, warc_writer  # noqa: E402
from topicloom.llm import queries as Q  # noqa: E402
from topicloom.runtime import run_path  # noqa: E402

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Columns of the operators' results, as an input may have them.
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, score string, word string, n int, node string"
PROSE = "the old lamp in the harbour still glows and the blue boats come home before the night falls on them all again "
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "12 !!"), (5, PROSE), (5, PROSE), (6, PROSE * 300), (7, "Aé 日本 😀"), (None, "x y"),
       (8, PROSE + "\n" + PROSE), (9, None)]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "en" if i != 7 else None, None, None, "s", "w", 1, "n") for i, t in ODD], CLASHES)


def empty_docs(spark):
    return spark.createDataFrame([], CLASHES)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_agrees_with_sql(spark, name):
    got = Q.QUERIES[name](spark, DIRECTORY).toPandas()
    assert difference(got, database(DIRECTORY).execute(oracles.ORACLES[name]).df()) is None


def test_rule_counts(spark):
    rows = host_rules.judge_hosts(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    want = Counter((i, *brute.rule_counts(t).values()) for i, t in ODD)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in rows) == want
    assert host_rules.judge_hosts(empty_docs(spark)).count() == 0


def test_a_bad_host_loses_its_good_documents(spark):
    rows = [(i, PROSE if i % 40 == 0 else "bad", "bad") for i in range(200)] + [
        (i, PROSE if i % 40 else "bad", "good") for i in range(200, 400)]
    kept = host_rules.judge_hosts(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("kept")
    assert {r.host for r in kept.collect()} == {"good"}


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=Q.piece_model())


def test_tokens_and_pieces_equal_the_library(spark, docs, library):
    texts = [(i, r.text) for i, r in docs.items()] + [(1000 + i, t) for i, (_, t) in enumerate(ODD)] + [
        (2000, "▁a ▁▁b  "), (2001, "<s> </s> <0x0A> <unk>"), (2002, "\x00a\x01\r\n;\r"), (2003, "a" * 300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    counted = {r.doc_id: r for r in bpe_count.count_tokens(frame, Q.piece_model()).collect()}
    coded = {r.doc_id: r for r in pieces.encode_decode(frame, Q.piece_model()).collect()}
    for i, text in texts:
        ids = library.encode(text or "")
        assert counted[i].n_tokens == len(ids) and counted[i].n_bytes == len((text or "").encode())
        assert coded[i].ids == [*ids, library.eos_id()] and coded[i].decoded == library.decode(coded[i].ids)
    assert bpe_count.count_tokens(empty_docs(spark), Q.piece_model()).count() == 0


def test_contamination(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:20])), (2, "Tiny item"), (3, None), (None, "no id at all"), (4, "!!"), (1, " ".join(words[30:50]))]
    texts = [(1, " ".join(words)), (2, "a TINY, item here " * 3), (3, " ".join(words[5:17])), (4, None), (5, ""),
             (6, " ".join(["x"] * 300 + words[:13])), (6, " ".join(["x"] * 200 + words[:13] + words[31:50])), (7, "tiny")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in texts], "doc_id long, text string, n_hit int, items int")
    windows = brute.item_windows(items)
    want = Counter((i, *(brute.contamination(t, windows)[k] for k in ("n_words", "n_hit", "contaminated"))) for i, t in texts)

    def found(**limits):
        return decontaminate.find_spans(frame, benchmark, **limits).collect()
    got = decontaminate.judge(frame, benchmark)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got.collect()) == want
    assert sorted(map(str, found(size=40))) == sorted(map(str, found()))  # several index blocks, the same spans
    kept = decontaminate.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in want.elements() if not r[3])
    assert decontaminate.drop_contaminated(frame, benchmark.limit(0)).count() == len(texts)


def test_winnowing_meets_every_long_run():
    rng = np.random.default_rng(5)
    for _ in range(50):
        words = rng.integers(0, 3, 40).astype(np.uint64)
        at, _ = decontaminate.winnow(words, np.zeros(40, np.int64))
        for start in range(40 - decontaminate.ITEM_WINDOW + 1):
            assert ((at >= start) & (at <= start + decontaminate.ITEM_WINDOW - decontaminate.K)).any()


def test_context_tree_is_the_recursive_weighting(spark, monkeypatch):
    texts = [b"abracadabra", b"abra", b"", b"banana bandana"]
    column = pa.array([t.decode() for t in texts])
    data, bounds = context_tree.B.text_bytes(column)
    grams, times = np.unique(context_tree.byte_grams(data, bounds), return_counts=True)
    parts = [(d, (g >> 8) & ((1 << 8 * d) - 1), g & 255, n) for g, n in zip(grams.tolist(), times.tolist(), strict=True)
             for d in range(context_tree.DEPTH + 1)]
    summed = Counter()
    for d, c, v, n in parts:
        summed[d, c, v] += n
    tree = context_tree.build_tree(*(np.array(x) for x in zip(*((*k, n) for k, n in summed.items()), strict=True)))
    assert np.allclose((10.0 ** tree.logs.astype(float)).sum(axis=1), 1, atol=1e-4)

    def estimate(z, o):
        return math.lgamma(z + .5) + math.lgamma(o + .5) - 2 * math.lgamma(.5) - math.lgamma(z + o + 1)

    def weighted(seen, prefix, depth, context):  # log probability of all bits seen at a decision below a context
        bits = [(v >> (7 - len(prefix))) & 1 for c, v in seen if c.endswith(context) and f"{v:08b}".startswith(prefix)]
        own = estimate(bits.count(0), bits.count(1))
        if depth == context_tree.DEPTH or not bits:
            return own
        below = sum(weighted(seen, prefix, depth + 1, bytes([y]) + context)
                    for y in {c[-depth - 1] for c, _ in seen if c.endswith(context)})
        return np.logaddexp(own, below) - math.log(2)
    seen = [(p[i:i + context_tree.DEPTH], p[i + context_tree.DEPTH]) for t in texts
            for p in [bytes(context_tree.DEPTH) + t + b"\0"] for i in range(len(t) + 1)]
    for context, value in [(b"\0\0abr", 97), (b"racad", 98), (b"\0\0\0\0\0", 98), (b"zzzab", 114)]:
        total = sum(weighted([*seen, (context, value)], f"{value:08b}"[:b], 0, b"") - weighted(seen, f"{value:08b}"[:b], 0, b"")
                    for b in range(8))
        state = 0
        for byte in context:
            state = tree.following[state, byte]
        assert abs(total / math.log(10) - tree.logs[state, value]) < 1e-3
    score = tree.score(data, bounds)
    step = [0.0] * len(texts)
    for k, t in enumerate(texts):
        state = 0
        for byte in bytes(context_tree.DEPTH):
            state = tree.following[state, byte]
        for byte in t + b"\0":
            step[k] += tree.logs[state, byte]
            state = tree.following[state, byte]
    assert np.allclose(score, step)


def test_base_score(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "HOT_WORDS", 4)  # most words go through the join
    frame = odd_docs(spark)
    training = frame.filter("doc_id is not null and doc_id <> 8")
    counts = Counter()
    for i, t in ODD:
        if i is not None and i != 8:
            counts.update([*brute.WORD.findall(brute.lower(t)), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    rows = context_tree.score(frame, training).collect()
    assert len(rows) == len(ODD) and {r.train_tokens for r in rows} == {total}
    want = sorted((i or 0, len(w), sum(counts[x] > 0 for x in w),
                   round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), 6))
                  for i, t in ODD for w in [[*brute.WORD.findall(brute.lower(t)), "\n"]])
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert context_tree.score(frame, training.limit(0)).count() == len(ODD)
    assert context_tree.score(empty_docs(spark), training).count() == 0


def test_archives(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/1", big), (2, "http://a/2 b", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "é", ""),
            (None, "u", big), (7, "u", big), (7, "v", big), (8, "u", "日" * 500)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    made = []
    for order in ("page_id", "html"):
        path = run_path(spark, "warc-test")
        manifest = warc_writer.write_archives(pages.orderBy(order), path, roll=600).orderBy("file").collect()
        made.append(sorted((r.file, r.sha256) for r in manifest))
        assert sum(r.records for r in manifest) == len(rows)
    assert made[0] == made[1]
    back = warc_writer.read_archives(spark, path).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in back) == Counter(
        [(1, "revisit", 7), (2, "revisit", 7), (3, "response", None), (4, "response", None), (5, "response", None),
         (6, "response", None), (None, "response", None), (7, "response", None), (7, "response", None), (8, "response", None)])
    assert {(r.page_id, bytes(r.payload).decode()) for r in back if r.payload is not None} >= {(8, "日" * 500), (5, "")}
    path = run_path(spark, "warc-test")
    assert warc_writer.write_archives(pages.limit(0), path).count() == 0
    assert warc_writer.read_archives(spark, path).count() == 0


def test_context_tree_stays_finite_and_whole_with_large_counts():
    # "a" (0x61) has ones: their chance is one in float32 here, and the other outcome's was zero
    n = 500_000_011
    rows = [(0, 0, 97, n), (0, 0, 98, 3), (1, 97, 97, n - 7), (1, 97, 98, 2), (1, 98, 98, 1), (1, 98, 97, 2)]
    tree = context_tree.build_tree(*(np.array(c, np.int64) for c in zip(*rows, strict=True)))
    assert np.isfinite(tree.logs).all()
    assert np.allclose((10.0 ** tree.logs.astype(float)).sum(axis=1), 1, atol=1e-4)


def _recursive_logs(known, asked, depth=context_tree.DEPTH):
    """log10 of each asked (context, byte) by context-tree weighting over dictionaries, every context kept."""
    counts = {}
    for context, byte in known:
        for d in range(depth + 1):
            for level in range(8):
                pair = counts.setdefault((context[depth - d:], level, byte >> 8 - level), [0, 0])
                pair[byte >> 7 - level & 1] += 1
    below, keep = Counter(), {}
    for node in sorted(counts, key=lambda node: -len(node[0])):
        zero, one = counts[node]
        own = math.lgamma(zero + .5) + math.lgamma(one + .5) - 2 * math.lgamma(.5) - math.lgamma(zero + one + 1)
        keep[node] = 1.0
        if len(node[0]) < depth:
            keep[node] = 1 / (1 + math.exp(below[node] - own))
            own = np.logaddexp(own, below[node]) - math.log(2)
        below[node[0][1:], *node[1:]] += own
    made = {}
    for context, byte in asked:
        total = 0.0
        for level in range(8):
            chance, share = 0.0, 1.0
            for d in range(depth + 1):
                node = (context[depth - d:], level, byte >> 8 - level)
                pair = counts.get(node, (0, 0))
                weight = keep.get(node, 1.0)
                chance += share * weight * (pair[byte >> 7 - level & 1] + .5) / (sum(pair) + 1)
                share *= 1 - weight
            total += math.log10(chance)
        made[context, byte] = total
    return made


def test_context_tree_keeps_every_context(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqr st"), 800)) for _ in range(22)] + ["", "aaaa aaaa", "Größe 日本", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    training = frame.filter("doc_id <> 3")

    def grams(text):
        data = bytes(context_tree.DEPTH) + "".join(c.lower() if c.isascii() else c for c in text or "").encode() + b"\0"
        return [(data[i:i + context_tree.DEPTH], data[i + context_tree.DEPTH]) for i in range(len(data) - context_tree.DEPTH)]
    known = [g for i, t in enumerate(texts) if i != 3 for g in grams(t)]
    assert len({c[5 - d:] for c, _ in known for d in range(6)}) > 32_768  # more than the tree once kept
    logs = _recursive_logs(known, {g for t in texts for g in grams(t)})
    for size, lot in ((1 << 17, 8 << 20), (500, 3000)):  # one slice and lot, and many
        monkeypatch.setattr(context_tree, "SLICE", size, raising=False)
        monkeypatch.setattr(context_tree, "LOT", lot, raising=False)
        found = {r.doc_id: r.score for r in context_tree.score(frame, training).collect()}
        for i, text in enumerate(texts):
            assert abs(found[i] - sum(logs[g] for g in grams(text))) < 1e-3, i


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    common, own = rng.integers(1, 1 << 49, 80), [rng.integers(1, 1 << 49, 20) for _ in range(2)]
    elements = [np.sort(np.concatenate([common, o])).astype(np.uint64) for o in own]
    rows = np.repeat([0, 1], 100)
    made = prob_minhash.signatures(rows, np.concatenate(elements), np.ones(200), 2, 2048)
    assert abs((made[0] == made[1]).mean() - 80 / 120) < 0.04
    one = prob_minhash.signatures(np.zeros(1, int), np.ones(1, np.uint64), np.ones(1), 1)
    assert (one == one[0, 0]).all()


def test_near_duplicates(spark, docs, monkeypatch):
    monkeypatch.setattr(prob_minhash, "CHUNK", 2)  # cells of several chunks
    words = [f"w{i}" for i in range(300)]
    family = [" ".join(words[:k * 17] + [f"new{k}"] + words[k * 17 + 1:]) for k in range(12)]
    texts = [(i, r.text) for i, r in docs.items()] + [(5000 + k, t) for k, t in enumerate(family)] + [
        (6000, None), (6001, None), (6002, ""), (6003, ""), (6004, "one two"), (6005, "One two!"), (6006, "!!")]
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(
        spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, node int, band string")).collect()}
    sets = {i: brute.shingles(t) for i, t in texts}
    ids = [i for i, _ in texts]
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if sets[i] and sets[j] and brute.jaccard(sets[i], sets[j]) >= 0.8:
                assert got[i] == got[j]
    assert {got[5000 + k] for k in range(12)} == {5000} and got[6005] == 6004 and got[6003] == 6002
    assert got[6000] == 6000 and got[6001] == 6001 and got[6006] == 6006
    assert prob_minhash.classes(empty_docs(spark)).count() == 0
    kept = prob_minhash.keep_first(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9]


def test_repeated_lines_edited_throughout_share_a_band(spark):
    rows = []
    for i in range(24):
        body = " ".join(f"b{i}w{j}" for j in range(200))
        for side in "xy":  # every fifth word of a line that stands 50 times differs
            line = " ".join(f"{side if j % 5 == 0 else 'l'}{i}n{j}" for j in range(20))
            rows.append((f"{i}{side}", body + f"\n{line}" * 50))
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in (text.split() for _, text in rows)]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    bands = {r.doc_id: set(r.bands) for r in prob_minhash.sketch(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(bands[f"{i}x"] & bands[f"{i}y"] for i in range(24))


def test_leftover_members_meet_the_class_of_the_hub(spark, monkeypatch):
    """h-b-a is a chain, h the hub, a unlike h; d, e and f are alike, and unlike the others."""
    monkeypatch.setattr(prob_minhash, "CHUNK", 2)
    sets = {1: range(0, 100), 2: range(8, 108), 3: range(16, 116), 4: range(500, 600), 5: range(505, 605), 6: range(510, 610)}
    table = spark.createDataFrame([(n, list(s)) for n, s in sets.items()], "node long, shingles array<long>")
    rest = spark.createDataFrame([(n, 7, n == 2) for n in sets if n > 1], "node long, band long, same boolean")
    edges = prob_minhash.compare_rest(rest, table).union(spark.createDataFrame([(2, 1)], "node long, hub long"))
    got = {r.node: r.root for r in prob_minhash.components(edges).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 6: 4}


def test_secrets():
    number = b"\x02\x01\x01"
    rsa = b"\x02\x01\x00" + number * 8
    der = b"\x30" + bytes([len(rsa)]) + rsa
    padded = b"\x02\x20" + b"\x01" * 32
    key = b"\x02\x01\x00" + padded * 3 + number * 5
    key = b"\x30\x81" + bytes([len(key)]) + key if len(key) > 127 else b"\x30" + bytes([len(key)]) + key
    assert secret_scan.is_der_key(der) and secret_scan.is_der_key(key) and not secret_scan.is_der_key(der[:-1])
    header = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    body = base64.urlsafe_b64encode(b'{"sub": 1}').decode().rstrip("=")
    text = f"é {base64.b64encode(key).decode()} and {header}.{body}.abc token: x PASSWORD='hunter22' {'ab' * 12} {'A' * 60}"
    kinds = [k for _, _, k in secret_scan.all_spans(text)]
    assert kinds == ["der", "jwt", "assign", "hex"]
    for s, e, k in secret_scan.all_spans(text):
        assert k != "hex" or text[s:e] == "ab" * 12
    clean = secret_scan.redact_text(text)
    assert "hunter22" not in clean and clean.startswith("é [der] and [jwt] token: x [assign]' [hex]")
    for t in ["ſecret=abcdefgh", "token=a:token=abcdef", "AKIA" + "B" * 15, "x" * 10 + "AKIA" + "B" * 16, "api-key=123456", ""]:
        assert sorted((k, s, e) for s, e, k in secret_scan.base_spans(t)) == sorted(brute.base_secrets(t))


def _der(tag, *parts):
    body = b"".join(parts)
    size = len(body).to_bytes(2, "big").lstrip(b"\0")
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x80 | len(size)]) + size) + body


def test_keys_of_every_alphabet_wrapping_and_kind():
    random = np.random.default_rng(3)

    def number(n):
        return _der(2, b"\x01" + random.bytes(n - 1))

    def wrapped(data, width=64):
        body = base64.b64encode(data).decode()
        return "\n".join(body[i:i + width] for i in range(0, len(body), width))

    def spans(text):
        return [(text[s:e], k) for s, e, k in secret_scan.all_spans(text)]
    zero = _der(2, b"\0")
    for _ in range(200):  # '-' or '_' stands anywhere
        rsa = _der(0x30, zero, *[number(32) for _ in range(8)])
        for encode in (base64.urlsafe_b64encode, base64.b64encode):
            key = encode(rsa).decode()
            assert spans(f"key: {key} end") == [(key, "der")]
    dsa = _der(0x30, zero, number(128), number(20), number(128), number(128), number(19))
    scheme = _der(0x30, _der(6, bytes.fromhex("2a864886f70d01050d")), _der(0x30))
    locked = _der(0x30, scheme, _der(4, random.bytes(160)))
    digest = _der(0x30, _der(0x30, _der(6, bytes.fromhex("608648016503040201"))), _der(4, random.bytes(64)))
    ssh = secret_scan._SSH + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") \
        + b"".join(len(x).to_bytes(4, "big") + x for x in (random.bytes(51), random.bytes(136)))
    for data, kind in ((rsa, "der"), (dsa, "der"), (locked, "der"), (ssh, "ssh")):
        one = base64.b64encode(data).decode()
        assert spans(f"a {one}.") == [(one, kind)]
        for width in (20, 64, 76):
            assert spans(f"see\n{wrapped(data, width)}\nwords behind\n{wrapped(data, width)} x") == [(wrapped(data, width), kind)] * 2
        for label in ("RSA PRIVATE KEY", "ENCRYPTED PRIVATE KEY"):
            pem = f"-----BEGIN {label}-----\nComment: a, b\n\n{wrapped(data)}\n-----END {label}-----"
            assert spans(f"x {pem} y")[0] == (pem, "pem")
    assert not spans(base64.b64encode(digest).decode()) and not spans(wrapped(digest))
    assert not spans(wrapped(rsa)[:-8]) and not spans(wrapped(rsa[:-3]))
    head = "Proc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC," + "0A" * 16
    for n, found in ((160, 1), (150, 0)):
        pem = f"-----BEGIN RSA PRIVATE KEY-----\r\n{head}\r\n\r\n{wrapped(random.bytes(n))}\r\n-----END RSA PRIVATE KEY-----"
        assert spans(pem) == [(pem, "pem")] * found


def test_secret_scan_of_tables(spark, docs):
    rows = Q.op9_secrets(spark, DIRECTORY).collect()
    for r in rows:
        spans = brute.base_secrets(docs[r.doc_id].text)
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    assert secret_scan.scan(odd_docs(spark)).count() == len(ODD)
    assert secret_scan.redact(odd_docs(spark)).columns == odd_docs(spark).columns


def test_language(spark, docs):
    sample = b"the cat sat on the mat and the dog"
    automaton = language.Automaton.of(sample)
    for text in (b"the dog sat", b"zzz", b"the catz on them", b"q", b""):
        data = np.frombuffer(text, np.uint8)
        assert automaton.phrases(data, np.array([0, len(text)]))[0] == brute.phrases(text, sample)
    rows = Q.op10_language(spark, DIRECTORY).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    odd = language.identify(odd_docs(spark), odd_docs(spark)).collect()
    assert len(odd) == len(ODD) and {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 3, 4, 9}
    assert {r.lang_pred for r in language.identify(odd_docs(spark), empty_docs(spark)).collect()} == {"und"}


def test_quality(spark):
    directory = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{directory}/labels.parquet").collect()}
    rows = [r for r in Q.op1_quality(spark, directory).collect() if r.doc_id in labels and r.held_out]
    good = [r.score for r in rows if labels[r.doc_id] == 1]
    bad = [r.score for r in rows if labels[r.doc_id] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    frame = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality_gam.score(frame, quality_gam.learn(frame, none)).collect()} == {0.5}
    rng = np.random.default_rng(1)
    values = rng.normal(size=(2000, 4))
    model = quality_gam.fit(values, ((values[:, 0] * values[:, 1]) > 0).astype(float))  # an interaction alone
    assert ((model.score(values) > 0.5) == (values[:, 0] * values[:, 1] > 0)).mean() > 0.9


def test_pipeline(spark, docs, library):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, DIRECTORY).collect()}
    kept = {i: r.text for i, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    sets, parent = {i: brute.shingles(t) for i, t in kept.items()}, {i: i for i in kept}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in sorted(kept):
        for j in kept:
            if j < i and brute.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    windows = brute.item_windows((r.item_id, r.text) for r in spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").collect())
    want = {i for i in kept if root(i) == i and not brute.contamination(kept[i], windows)["contaminated"]}
    assert rows.keys() == want
    for i in want:
        ids = [*library.encode(secret_scan.redact_text(kept[i])), library.eos_id()]
        assert rows[i].ids_sha256 == brute.sha(" ".join(map(str, ids)))
