import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendalloc.functions import vocab as V
from spendalloc.operators import dedup as X

D = dt.date(2026, 7, 1)
SCHEMA = (
    "source_seq int, row_no bigint, source_file string, source_type string, doc_date date, person_raw string, "
    "amount decimal(18,6), currency string, cost_center string, decision string, site_label string, "
    "shares array<struct<label string, num int, den int>>")


def table(spark, rows):
    """rows: (feed, type, date, person, amount[, shares])."""
    feeds = {}
    out = []
    for r in rows:
        seq = feeds.setdefault(r[0], len(feeds))
        n = sum(1 for o in out if o[0] == seq) + 1
        out.append((seq, n, r[0], r[1], r[2], r[3], Decimal(str(r[4])), "USD", "GPP", "AUTO", None,
                    r[5] if len(r) > 5 else None))
    return X.prepare(spark.createDataFrame(out, SCHEMA))


def run(spark, rows):
    t = table(spark, rows)
    kept, pairs = X.eliminate(t)
    return t, kept, pairs


L, M, G = V.TRAVEL_LEDGER, V.DISTRIBUTED, V.GENERIC


CASES = [
    ([("a", L, "SAHTEOGLU MUSTAFAKEMAL", 100), ("b", M, "MUSTAFA KEMAL SAHTEOGLU", 100)], [3]),
    ([("a", L, "SAHTEOGLU MUSTAFAKEMA", 100), ("b", M, "MUSTAFA KEMAL SAHTEOGLU", 100)], [2]),
    ([("a", L, "ALI VELI", -16), ("b", M, "VELI ALI", 16)], [3]),
    ([("a", L, "ALI VELI", 227.46), ("a", L, "AYSE FATMA", 227.46)], []),
    ([("c", G, "MEHMET YILMAZ", 120), ("d", G, "MEHMET DEMIR", 120)], []),
    ([("a", L, "YILMAZ MEHMET", 120), ("b", M, "MEHMET YILMAS", 120)], [1]),
    ([("m.msg > e", G, "YILMAZ MEHMET", 120), ("m.msg > f", G, "MEHMET YILMAS", 120)], [1]),
    ([("a", L, None, 50), ("b", M, None, 50)], [0]),
    ([("a", L, None, 50), ("b", M, "ALI VELI", 50)], []),
]


def test_pairs(spark):
    # One bucket per case, all cases in one run.
    rows = [(f, k, D + dt.timedelta(days=i), p, a) for i, (case, _) in enumerate(CASES) for f, k, p, a in case]
    rows += [("a", L, None, "ALI VELI", 50), ("b", M, None, "ALI VELI", 50)]
    _, kept, pairs = run(spark, rows)
    got = {}
    for r in pairs.collect():
        got.setdefault((r["doc_date"] - D).days, []).append(r["tier"])
    assert [got.get(i, []) for i in range(len(CASES))] == [t for _, t in CASES]
    assert kept.count() == len(rows) - sum(len(t) for _, t in CASES)


def test_evidence(spark):
    t, kept, pairs = run(spark, [
        ("a", L, D, "ALI VELI", -16), ("b", M, D, "VELI ALI", 16, [("RHI", 1, 3)]),
        ("a", L, D, "AYSE FATMA", 200), ("b", M, D, "FATMA AYSE", 201),
        ("a", L, None, "CAN TEK", 30), ("b", M, None, "TEK CAN", 30)])
    both = X.paired(t, pairs)
    c = X.sign_conflicts(both).collect()
    assert [(r["kept_amount"], r["removed_amount"]) for r in c] == [(Decimal("-16.00"), Decimal("16.00"))]
    s = {(r["feed"], r["reason"]): r for r in X.suspicions(t, kept, pairs).collect()}
    assert s[("b", "amount_changed")]["amount"] == Decimal("201.00")
    assert s[("b", "undated_repeat")]["other_feed"] == "a"
    assert ("a", "amount_changed") not in s
    row = kept.filter("feed = 'a' and amount < 0").head()
    assert row["inherited_shares"][0]["label"] == "RHI"
    kept2, none = X.eliminate(t, enabled=False)
    assert none is None and kept2.count() == 6


def loop(rows):
    """Plain first-fit loop over one bucket, as the rules are written."""
    def sig(n):
        return "".join(sorted(n.replace(" ", "")))

    def contained(a, b):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        it = iter(b)
        return len(b) - len(a) <= 4 and all(ch in it for ch in a)

    def score(a, b):
        if not a or not b:
            return 0
        if sig(a) == sig(b):
            return 3
        if contained(sig(a), sig(b)):
            return 2
        return 1 if set(a.split()) & set(b.split()) else 0

    kept = [(i, r[3] or "") for i, r in enumerate(rows) if r[0] == "a"]
    wait = [(i, r[3] or "") for i, r in enumerate(rows) if r[0] == "b"]
    out = set()
    for level in (3, 2, 1):
        rest = []
        for d in wait:
            hit = next((t for t in kept if score(t[1], d[1]) >= level), None)
            if hit is None:
                rest.append(d)
            else:
                kept.remove(hit)
                out.add((d[0], hit[0]))
        wait = rest
    out |= {(d[0], t[0]) for d, t in zip([d for d in wait if not d[1]], [t for t in kept if not t[1]])}
    return out


def test_same_as_the_loop(spark):
    rnd = random.Random(5)
    words = ["ALI", "ANIL", "VELI", "CAN", "MEHMET", "MEHME", "AYSE", "AYSEN", "KAYA", "KAYAN", "DEMIR"]
    days = [[], [], [], []]
    for n, day in enumerate(days):
        for feed, kind in (("a", L), ("b", M)):
            for _ in range(20):
                name = " ".join(rnd.sample(words, rnd.choice([1, 2, 2, 3]))) if rnd.random() > 0.1 else None
                day.append((feed, kind, D + dt.timedelta(days=n), name, 10))
    rows = [r for day in days for r in day]
    t, _, pairs = run(spark, rows)
    index = {}
    count = {}
    for i, r in enumerate(rows):
        count[r[0]] = count.get(r[0], 0) + 1
        index[("a" if r[0] == "a" else "b", count[r[0]])] = i
    got = {(index[("b", r["o_row"])], index[("a", r["k_row"])]) for r in pairs.collect()}
    want, start = set(), 0
    for day in days:
        want |= {(o + start, k + start) for o, k in loop(day)}
        start += len(day)
    assert got == want


def test_block_rank(spark):
    from spendalloc.operators.common import block_row_number
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.lit(0).alias("seq"), F.col("id").alias("row"))
    got = block_row_number(df, ["g"], ["seq", "row"], "rn", block_rows=64)
    assert got.filter(F.col("rn") != F.floor(F.col("row") / 3) + 1).count() == 0
