"""Filter audit against a plain restatement of its contract, and on odd rows."""

import os
import re
import sys
from itertools import permutations

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from topicloom.llm import filter_audit as A  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, e string, h1 string"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(400))


def brute(docs, labels):
    marks = {}
    for i, q, x in labels:
        if i is not None:
            g, t = marks.get(i, (False, False))
            marks[i] = (g or q == 1, t or x == 1)
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = [j for j, u, _ in docs if j is not None and i is not None and j < i and (u or "") == t]
        flags = [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), bool(smaller)]
        rows.append((source or "", flags, *marks.get(i, (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_by = {c: 0 for c in "ABCDE"}
        per = {}
        for order in permutations("ABCDE"):
            alive = list(mine)
            for step, c in enumerate(order, 1):
                k = "ABCDE".index(c)
                gone = [r for r in alive if r[1][k]]
                alive = [r for r in alive if not r[1][k]]
                redundant = sum(1 for r in mine if r[1][k]) - len(gone)
                unique = sum(1 for r in mine if r[1][k] and sum(r[1]) == 1)
                per[(part, "".join(order), step)] = [len(alive), len(gone), redundant, unique,
                                                     sum(r[2] for r in gone), sum(r[3] for r in gone), c]
                removed_by[c] += len(gone)
        for key, v in per.items():
            out[key] = tuple(v[:6]) + (removed_by[v[6]],)
    return out


def run(spark, docs, labels):
    frame = spark.createDataFrame([(i, t, "en", s, 1, "p", 1, "e", "h") for i, t, s in docs], DOCS)
    got = A.audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                               r.toxic_lost, r.shapley) for r in got}, len(got)


def test_audit_equals_brute_force_on_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, LONG, "a"), (4, LONG, "b"), (4, LONG, "b"), (None, LONG, None),
            (5, "ALL CAPS # here", None), (6, LONG + " $", "b"), (7, "x " * 300, "a"), (0, LONG, "c"),
            (8, "é " * 250 + "Aé", "a"), (9, None, "b")] + [(100 + i, LONG, "hot") for i in range(60)]
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, 1), (None, 1, 1), (7, 1, 0), (100, 1, 1), (130, 0, 1)]
    got, n = run(spark, docs, labels)
    assert n == len(got) == 5 * 120 * 5  # parts a, b, c, hot and the empty one
    assert got == brute(docs, labels)


def test_empty_table(spark):
    assert run(spark, [], []) == ({}, 0)


def test_orders_and_steps():
    steps = A._steps()
    assert len(steps) == 600 and len({s[0] for s in steps}) == 120
    assert all(s[3] & s[2] == 0 for s in steps)
