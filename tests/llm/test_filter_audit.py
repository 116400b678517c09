"""Filter interactions against a plain run of all orders."""

import re
from itertools import permutations

import numpy as np

from spendalloc.llm import filter_audit as fa

from .data import SCHEMA, frame, result, rows

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
           "shapley")
LABELS = "doc_id long, quality int, toxic int, text string"


def brute(data, good, toxic):
    docs = []
    for i, t, part in data:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        copy = i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in data)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        docs.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley, steps = {}, []
        for order in permutations("ABCDE"):
            left = mine
            for n, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] = shapley.get(f, 0) + len(gone)
                steps.append((f, ("".join(order), n, len(left), len(gone), sum(f in d[1] for d in mine) - len(gone),
                                  sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone))))
        out += [(part, *s, shapley[f]) for f, s in steps]
    return sorted(out, key=repr)


def test_against_all_orders(spark):
    data = rows()
    data += [(100 + i, "Shout # LOUD " * (i % 4) + "one two three four five " * (50 * (i % 2)), ("en", "de", "")[i % 3],
              "s", 1, 2, b"k", "c", "c", 9) for i in range(30)]
    labels = [(i, i % 2, int(i % 3 == 0), "x") for i in range(0, 130, 2)] + [(3, 1, None, "x"), (3, 1, 1, "x"), (None, 1, 1, "x")]
    good = {i for i, q, _, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x, _ in labels if x == 1} - {None}
    got = result(fa.filter_audit(frame(spark, data), spark.createDataFrame(labels, LABELS)), *COLUMNS)
    assert got == brute([(r[0], r[1], r[2]) for r in data], good, toxic)


def test_hot_copies_and_parts_without_failures(spark, monkeypatch):
    """A third of the rows are one text; the hot way and the other give the same."""
    fine = " ".join(f"w{i}" for i in range(300))
    data = [(i, fine if i % 3 == 0 else f"{fine} {i}", "aa" if i % 2 else "bb") for i in range(90)] + [(500, fine + " x", "cc")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    want = brute(data, set(), set())
    for hot in (1000, 1, 0):
        monkeypatch.setattr(fa, "HOT", hot)
        assert result(fa.filter_audit(docs, labels), *COLUMNS) == want
    assert len([r for r in want if r[0] == "cc" and r[4] == 0]) == 600


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert fa.filter_audit(docs, labels).count() == 0


def test_merges():
    r = np.random.default_rng(1)
    for n, m, top in [(0, 5, 9), (5, 0, 9), (1, 1, 2), (2000, 3, 10**6), (3, 5000, 10**4), (3000, 2500, 6000), (1500, 1500, 1500)]:
        for _ in range(5):
            a, b = (np.sort(r.choice(top, min(k, top), replace=False)).astype(np.int64) for k in (n, m))
            assert fa.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
            assert fa.union(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))
            assert fa.inside(a, b).tolist() == [x in set(b.tolist()) for x in a.tolist()]


def test_posting_lists_are_cut_by_range(spark, monkeypatch):
    monkeypatch.setattr(fa, "RANGE_BITS", 3)
    rows_ = spark.createDataFrame([(i, i, "p", b"%d" % i, ["A"] if i % 2 else []) for i in range(64)],
                                  "row long, doc_id long, part string, digest binary, fails array<string>")
    lists = fa.posting_lists(rows_, spark.createDataFrame([(3, 1, 1, "")], LABELS)).collect()
    assert len(lists) == 8 and sorted(x for r in lists for x in r["A"]) == list(range(1, 64, 2))
    assert all(x >> 3 == r["range"] for r in lists for x in r["A"]) and sum(len(r["label quality"]) for r in lists) == 1
