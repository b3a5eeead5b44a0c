"""Vector codes against a brute-force Lloyd's step, and on odd rows."""

import hashlib
import math
import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from topicloom.llm import queries as Q  # noqa: E402
from topicloom.llm import vector_codes as V  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def _key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def brute(rows):
    """Plain restatement of the contract over (vec_id, vector, label) tuples."""
    def fine(v):
        return v is not None and len(v) > 0 and len(v) % 16 == 0 and all(
            x is not None and math.isfinite(x) and abs(x) < V.LIMIT for x in v)
    kept = [(i, [math.floor(np.float32(x) * 256.0) for x in v], lab) for i, v, lab in rows if fine(v)]
    if not kept:
        return {}, None
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    dim = len(order[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    order = [r for r in order if len(r[1]) == dim]
    width = dim // 16
    books = [[r[1][p * width:(p + 1) * width] for r in order[:64]] for p in range(16)]

    def assign():
        out = []
        for _, e, _ in kept:
            codes, err = [], 0
            for p in range(16):
                part = e[p * width:(p + 1) * width]
                d = [sum((a - b) ** 2 for a, b in zip(part, c)) for c in books[p]]
                j = d.index(min(d))
                codes.append(j)
                err += d[j]
            out.append((codes, err))
        return out
    for _ in range(2):
        got = assign()
        for p in range(16):
            for j in range(len(books[p])):
                members = [kept[n][1][p * width:(p + 1) * width] for n, (c, _) in enumerate(got) if c[p] == j]
                if members:
                    books[p][j] = [sum(col) // len(members) for col in zip(*members)]
    got = assign()
    label_error = {}
    for (i, _, lab), (_, err) in zip(kept, got):
        label_error[lab] = label_error.get(lab, 0) + err
    result = sorted(((i, "".join(f"{c:02x}" for c in codes), err, label_error[lab]) for (i, _, lab), (codes, err)
                     in zip(kept, got)), key=_key)
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return result, digest


def run(spark, rows):
    frame = spark.createDataFrame([(i, v, lab, "c", "e") for i, v, lab in rows], SCHEMA)
    coded, books = V.encode(frame)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in V.with_label_error(coded).collect()), key=_key)
    return got, (V.codebook_digest(books) if got else None)


def test_codes_equal_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.2, (150, 32)).astype(np.float32)
    rows = [(i, base[i % 120].tolist(), int(i % 5) if i % 7 else None) for i in range(150)]
    rows += [(None, base[3].tolist(), 1), (5, base[5].tolist(), 0), (5, base[5].tolist(), 0),  # null id, repeats
             (900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, 1),
             (904, [], 1), (905, [0.1] * 31, 1), (906, [0.1] * 48, 1), (907, [1e6] * 32, 1)]
    got, digest = run(spark, rows)
    want, want_digest = brute(rows)
    assert got == want and digest == want_digest
    assert {r[0] for r in got}.isdisjoint(range(900, 908))


def test_few_rows_and_ties(spark):
    rows = [(i, [0.5] * 16, None) for i in range(5)] + [(9, [-0.5] * 16, 2)]
    got, digest = run(spark, rows)
    want, want_digest = brute(rows)
    assert got == want and digest == want_digest
    assert all(code == "00" * 16 for _, code, _, _ in got[:5])


def test_empty_and_all_dropped(spark):
    assert run(spark, []) == ([], None)
    assert run(spark, [(1, None, 1), (2, [float("nan")] * 16, 1)]) == ([], None)


def test_shortlist_keeps_every_possible_nearest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        book = rng.integers(-50, 50, (64, 4))
        box = rng.integers(-60, 60, (20, 4))
        lo, hi = box.min(0), box.max(0)
        short = set(V.shortlist(book, lo, hi).tolist())
        d = ((box[:, None, :] - book[None]) ** 2).sum(2)
        assert {int(j) for j in d.argmin(1)} <= short


def test_hilbert_keys_are_a_bijection_on_a_grid():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    keys = V.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(64))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # neighbours along the curve


def test_query_columns(spark):
    got = Q.op13_vector_codes(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
