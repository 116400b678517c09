import datetime as dt
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from spendalloc.functions import vocab as V
from spendalloc.operators import allocate as A
from spendalloc.operators import centers as Z
from spendalloc.operators import dedup as X
from spendalloc.operators import reconcile as C

D = dt.date(2026, 7, 3)
SCHEMA = (
    "source_seq int, row_no bigint, source_file string, source_type string, doc_date date, person_raw string, "
    "staff_id string, amount decimal(18,6), currency string, category string, cost_center string, "
    "cost_center_name string, in_map boolean, company string, company2 string, decision string, site_label string, "
    "shares array<struct<label string, num int, den int>>, declared map<string,decimal(18,6)>, doc_no string, "
    "invoice_no string")


def table(spark, rows):
    base = dict(source_seq=0, row_no=0, source_file="a.xls", source_type=V.TRAVEL_LEDGER, doc_date=D,
                person_raw="ALI VELI", staff_id="1", amount=Dec(100), currency="USD", category="Bilet",
                cost_center="GPP", cost_center_name="GPP", in_map=True, company="RHI", company2=None,
                decision="AUTO", site_label=None, shares=None, declared=None, doc_no=None, invoice_no=None)
    data = []
    for i, r in enumerate(rows):
        d = {**base, "row_no": i + 1, **r}
        if d["amount"] is not None:
            d["amount"] = Dec(str(d["amount"]))
        data.append(tuple(d.values()))
    return X.prepare(spark.createDataFrame(data, SCHEMA))


def keys(spark):
    m = spark.createDataFrame([("GPP Project", "GPP", "GPP", "RHI", True, 1), ("Udokan", "GMK", "Udokan", "BSK", True, 2)],
                              "site string, code string, name string, company string, active boolean, load_seq int")
    return Z.map_keys(m, {})


def settle(spark, rows):
    t = table(spark, rows)
    e = A.eligible(t)
    parts = A.explode_shares(e, keys(spark))
    out = A.settle_remainder(A.allocate(parts), C.targets(e))
    ctl = C.close(C.control(e, out, amountless=t.filter(A.line_kind() == "amountless")))
    return parts, out, ctl


def test_shares(spark):
    S = lambda *s: [tuple(x) for x in s]
    parts, out, ctl = settle(spark, [
        dict(source_file="a", amount=201.42, shares=S(("RHI", 1, 3), ("RENSTROYDETAL", 2, 3))),
        dict(source_file="b", amount=100, shares=S(("RHI", 1, 2)), company="UST LUGA"),
        dict(source_file="c", amount=100, shares=S(("RHI", 1, 2), ("RSD", 2, 3))),
        dict(source_file="d", amount=90, shares=S(("Udokan", 1, 3), ("GPP Project", 2, 3))),
        dict(source_file="e", amount=10, shares=S(("BILET", 2, 2))),
        dict(source_file="f", amount=10, decision="UNMATCHED", shares=S(("RHI", 1, 2))),
        dict(source_file="g", amount=10, cost_center=None),
    ])
    got = {}
    for r in out.collect():
        got.setdefault(r["feed"], []).append((r["cost_center"], r["company"], r["amount"], r["share_note"]))
    got = {k: sorted(v) for k, v in got.items()}
    assert got["a"] == [("GPP", "RHI", Dec("67.14"), "RHI 1/3"), ("GPP", "RSS", Dec("134.28"), "RENSTROYDETAL 2/3")]
    assert got["b"] == [("GPP", "RHI", Dec("50.00"), "RHI 1/2"), ("GPP", "UST LUGA", Dec("50.00"), "(rest 0.50)")]
    assert got["c"] == [("GPP", "RHI", Dec("100.00"), "SHARE ERROR: RHI 1/2, RSD 2/3")]
    assert got["d"] == [("GMK", "BSK", Dec("30.00"), "Udokan 1/3"), ("GPP", "RHI", Dec("60.00"), "GPP Project 2/3")]
    assert got["e"] == [("GPP", "RHI", Dec("10.00"), "")]
    assert got["f"] == [(V.UNALLOCATED, "", Dec("10.00"), "")] == got["g"]
    warn = {r["feed"]: r["share_warning"] for r in parts.filter("share_warning is not null").collect()}
    assert set(warn) == {"c", "e"}
    assert all(r["closed"] for r in ctl.collect())


def test_three_thirds(spark):
    S = [("RHI", 1, 3), ("RSS", 1, 3), ("BSK", 1, 3)]
    _, out, ctl = settle(spark, [dict(amount=100, shares=S)])
    assert sorted(r["amount"] for r in out.collect()) == [Dec("33.33"), Dec("33.33"), Dec("33.34")]
    assert ctl.head()["closed"]


def test_control(spark):
    _, out, ctl = settle(spark, [
        dict(source_file="a", amount=10, currency="usd ", doc_no="D1"), dict(source_file="a", amount=5, doc_no="D2"),
        dict(source_file="b", amount=5, currency=None), dict(source_file="c", amount=None), dict(source_file="c", amount=3),
        dict(source_file="d", amount=5, declared={"x": Dec("6.00")}), dict(source_file="e", amount=5, declared={"x": Dec("5.01")}),
        dict(source_file="f", amount=5, doc_date=None),
    ])
    got = {(r["feed"], r["currency"]): r for r in ctl.withColumn("status", C.control_status()).collect()}
    assert got[("a", "USD")]["read"] == Dec("15.00") and got[("a", "USD")]["status"] == "CLOSED"
    assert got[("b", "?")]["status"] == "OPEN - currency unknown"
    assert got[("c", "USD")]["n_amountless"] == 1 and not got[("c", "USD")]["closed"]
    assert got[("d", "USD")]["open_reason"] == "declared total differs by 1.00"
    assert got[("e", "USD")]["closed"]
    assert got[("f", "USD")]["status"].startswith("CLOSED, ATTENTION")
    row = [r for r in out.collect() if r["feed"] == "a"][0]
    assert row["doc_numbers"] == "D1, D2" and row["n_lines"] == 2 and row["n_persons"] == 1


def test_pools(spark):
    persons = spark.createDataFrame([(0, i, "RHI") for i in range(22)] + [(0, 100, "RSS")],
                                    "source_seq int, row_no bigint, company string")
    pools = A.pool_totals(spark.createDataFrame([("RHI", Dec("1709.9136")), ("RSD", Dec("76.78"))],
                                                "company string, amount decimal(18,6)"))
    out = A.split_pool(A.bridge_pools(persons, pools), pools)
    got = [r["amount"] for r in out.filter("pool_company = 'RHI'").orderBy("row_no").collect()]
    assert got == [Dec("77.73")] * 7 + [Dec("77.72")] * 15
    assert [r["amount"] for r in out.filter("pool_company = 'RSD'").collect()] == [Dec("76.78")]


def test_pool_of_most_persons_is_not_dealt_by_pool(spark):
    """Persons meet the sizes of their pools without being dealt out by the pool alone."""
    persons = spark.createDataFrame([(0, i, "RHI" if i % 9 else "RSD") for i in range(3000)],
                                    "source_seq int, row_no bigint, company string")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "20k")  # below the persons, above two pools
    try:
        pools = A.pool_totals(spark.createDataFrame([("RHI", Dec(100)), ("RSD", Dec("-0.05"))], "company string, amount decimal(18,6)"))
        out = A.split_pool(A.bridge_pools(persons, pools), pools)
        plan = out._jdf.queryExecution().executedPlan().toString()
        dealt = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "hashpartitioning(" in x]
        # By the pool alone only the counts of its blocks are dealt out.
        assert [len([x for x in dealt if ("_block" in x) == block]) for block in (False, True)] == [1, 2], dealt
        got = {r["pool_company"]: (r["n"], r["a"]) for r in out.groupBy("pool_company").agg(
            F.count(F.lit(1)).alias("n"), F.sum("amount").alias("a")).collect()}
        assert got == {"RHI": (2666, Dec("100.00")), "RSD": (334, Dec("-0.05"))}
        assert out.filter("pool_company = 'RHI'").orderBy("row_no").head()["amount"] == Dec("0.04")
    finally:
        spark.conf.set(limit, before)


def test_pools_of_other_spellings(spark):
    persons = spark.createDataFrame(
        [(0, 1, "RC Peter"), (0, 2, "rc_moskova"), (0, 3, "Renstroydetal"), (0, 4, "YENI A.S."), (0, 5, " "), (0, 6, None)],
        "source_seq int, row_no bigint, company string")
    detail = spark.createDataFrame(
        [("RC", Dec(10)), ("rc peter", Dec(5)), ("RSD", Dec(7)), ("Diger", Dec(4)), (None, Dec(9)), ("-", Dec(9)), ("RHI", None)],
        "company string, amount decimal(18,6)")
    pools = A.pool_totals(detail)
    assert {r["company"]: r["pool"] for r in pools.collect()} == {"RC": 15, "RSD": 7, "DIGER": 4}
    got = {r["row_no"]: (r["company"], r["pool_company"]) for r in A.bridge_pools(persons, pools).collect()}
    assert got == {1: ("RC Peter", "RC"), 2: ("rc_moskova", "RC"), 3: ("Renstroydetal", "RSD"), 4: ("YENI A.S.", "DIGER"),
                   5: (" ", None), 6: (None, None)}
    # Two pools without persons: none is chosen.
    more = A.pool_totals(detail.union(spark.createDataFrame([("Iki", Dec(1))], detail.schema)))
    assert A.bridge_pools(persons, more).filter("row_no = 4").head()["pool_company"] is None
    assert A.bridge_pools(persons.limit(0), pools).count() == 0


def test_detail_and_mismatch(spark):
    d = spark.createDataFrame([(0, 1, "F1", "det", "ALI", "AIL"), (0, 2, "F1", "det", "VELI", "EILV")],
                              "source_seq int, row_no int, invoice_no string, feed string, person string, sig string")
    c = spark.createDataFrame([(1, 1, "F1", "ALI", "AIL"), (1, 2, "F1", "CAN", "ACN")],
                              "source_seq int, row_no int, invoice_no string, person string, sig string")
    r = C.detail_check(d, c).head()
    assert (r["n_detail"], r["n_charged"], r["missing"], r["surplus"], r["consistent"]) == (2, 2, "VELI", "CAN", False)
    parts, out, ctl = settle(spark, [dict(site_label="RHI", company="RSS", amount=7), dict(site_label="RHI", amount=9)])
    m = C.company_mismatch(parts).collect()
    assert [(r["label_company"], r["company"], r["n_lines"], r["amount"]) for r in m] == [("RHI", "RSS", 1, Dec("7.00"))]
    gate = C.release_gate(ctl, out, parts).head()
    assert gate["gate"] == "CLOSED"
    tot = C.totals(ctl).head()
    assert tot["net"] == Dec("16.00") and tot["rate"] == Dec("100.00")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_common_share_list_stay_where_they_are(spark):
    t = A.eligible(table(spark, [dict(amount=i + 1, shares=[("RHI", 1, 3), ("RSS", 2, 3)]) for i in range(20)]))
    parts = A.explode_shares(t, keys(spark))
    # The list's plan goes to the lines; they are neither shuffled by their list nor sorted.
    assert "BroadcastHashJoin" in plan_of(parts) and "SortMergeJoin" not in plan_of(parts)
    assert parts.count() == 40 and parts.agg(F.sum("part")).head()[0] == Dec(210)


def test_first_centre_of_a_row(spark):
    t = A.eligible(table(spark, [
        dict(source_seq=2, row_no=1, cost_center_name="late", in_map=False),
        dict(source_seq=1, row_no=9, cost_center_name="first", in_map=True),
        dict(source_seq=3, row_no=None, cost_center_name="last"),
        dict(source_file="b", row_no=4, cost_center_name="four"), dict(source_file="b", row_no=None, cost_center_name=None),
    ])).withColumn("feed", F.nullif("feed", F.lit("b")))
    parts = A.explode_shares(t, keys(spark))
    got = {r["feed"]: r for r in A.allocate(parts, details=False).collect()}
    assert set(got) == {"a.xls", None}
    assert (got["a.xls"]["cost_center_name"], got["a.xls"]["in_map"], got["a.xls"]["n_lines"]) == ("first", True, 3)
    # A null number comes first, and a row of null keys keeps its centre.
    assert (got[None]["cost_center_name"], got[None]["n_lines"], got[None]["n_persons"]) == (None, 2, 1)
    # Every part goes through hash aggregates; only their few rows are sorted.
    assert "SortAggregate" not in plan_of(A.allocate(parts, details=False, centers=False))
    # Texts of the first part are compared after numbers were reduced per name.
    assert plan_of(A.allocate(parts, details=False)).count("HashAggregate") > plan_of(
        A.allocate(parts, details=False, centers=False)).count("HashAggregate")


def test_settling_reads_written_rows(spark):
    S = [("RHI", 1, 3), ("RSS", 1, 3), ("BSK", 1, 3)]
    t = A.eligible(table(spark, [dict(amount=100, shares=S)]))
    out = A.settle_remainder(A.allocate(A.explode_shares(t, keys(spark)), details=False), C.targets(t))
    # The parts are unfolded once, before the rows meet themselves.
    assert "Generate" not in plan_of(out)
    assert sorted(r["amount"] for r in out.collect()) == [Dec("33.33"), Dec("33.33"), Dec("33.34")]
