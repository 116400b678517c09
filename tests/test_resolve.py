import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from spendalloc.operators import asof as A
from spendalloc.operators import centers as Z
from spendalloc.operators import roster as R
from tests.fixtures import snap

D = dt.date
ROWS = [
    ("900123", "Test Kisi", "GPP Project", D(2026, 5, 1)), ("900123", "Test Kisi", "GPP Project", D(2026, 6, 1)),
    ("900123", "Test Kisi", "Udokan (GMK)", D(2026, 7, 1)), ("900123", "Test Kisi", "ESKI PROJE", None),
    ("1", "Bos Donem", "GPP Project", None),
    ("2", "Ayrilan Kisi", "GPP Project", D(2026, 5, 1), {"category": "Çıkış", "exit_date": D(2026, 5, 20)}),
    ("3", "Haritasiz Kisi", "Yeni Proje", D(2026, 7, 1), {"company2": "RSS"}),
    ("4", "Eski Calisan", "GPP Project", D(2026, 7, 1), {"hire_date": D(2020, 1, 1)}),
]
MAP = [("GPP Project", "GPP", "GPP", "RHI", True, 1), ("Udokan (GMK)", "GMK", "Udokan", "RHI", False, 2)]


def test_latest(spark):
    got = {r["staff_id"]: r["site"] for r in R.latest(snap(spark, ROWS)).collect()}
    assert got["900123"] == "Udokan (GMK)" and got["1"] == "GPP Project"


def test_as_of(spark):
    rows = [("900123", None), ("900123", D(2026, 6, 15)), ("900123", D(2026, 1, 1)), ("900123", D(2026, 7, 31)),
            ("900123", D(2026, 8, 2)), ("1", D(2026, 6, 1)), ("2", D(2026, 6, 10)), (None, D(2026, 6, 1)), ("x", None)]
    df = spark.createDataFrame([(i, a, b, Decimal(1)) for i, (a, b) in enumerate(rows)],
                               "i int, staff_id string, doc_date date, amount decimal(18,2)")
    got = {r["i"]: (r["site"], r["relation"]) for r in A.as_of(df, snap(spark, ROWS)).collect()}
    assert got == {
        0: ("Udokan (GMK)", "undated"), 1: ("GPP Project", "same_month"), 2: ("GPP Project", "before_first"),
        3: ("Udokan (GMK)", "same_month"), 4: ("Udokan (GMK)", "roster_stale"), 5: ("GPP Project", "undated"),
        6: ("GPP Project", "earlier"), 7: (None, None), 8: (None, None)}


def cmap(spark):
    return spark.createDataFrame(MAP, "site string, code string, name string, company string, active boolean, load_seq int")


def test_map_keys(spark):
    keys = {r["key"]: r["code"] for r in Z.map_keys(cmap(spark)).collect()}
    assert keys["GPP PROJECT"] == "GPP" and keys["GPP PROJE"] == "GPP" and keys["UDOKAN"] == "GMK"
    assert keys["GMK"] == "GMK"


def resolve(spark, rows, **kw):
    base = dict(i=0, staff_id=None, matched_name=None, method="exact_name", confidence=0.95, norm="", nid="",
                doc_date=D(2026, 7, 5), amount=Decimal(10), site_label=None, reader_warning=None)
    schema = ("i int, staff_id string, matched_name string, method string, confidence double, norm string, "
              "nid string, doc_date date, amount decimal(18,2), site_label string, reader_warning string")
    data = [tuple({**base, **r, "i": n}.values()) for n, r in enumerate(rows)]
    df = spark.createDataFrame(data, schema)
    sec = spark.createDataFrame(
        [("77", "Grup Kisi", "GRUP KISI", "GRUP KISI", "Lytkarino", "RSS LLC", "RSS", 1),
         ("78", "Eski Calisan", "ESKI CALISAN", "CALISAN ESKI", "Lytkarino", "RSS LLC", "RSS", 2),
         ("2", "Ayrilan Kisi", "AYRILAN KISI", "AYRILAN KISI", "Lytkarino", "RSS LLC", "RSS", 3)],
        "staff_id string, full_name string, norm string, tkey string, site string, company string, company2 string, load_seq int")
    led = {"external": spark.createDataFrame([("DIS KISI", "Dis Kisi", "GPP", 1)],
                                             "name_norm string, full_name string, cost_center string, load_seq int")}
    out = Z.resolve_lines(df, snap(spark, ROWS), cmap(spark), sec, led, **kw)
    return {r["i"]: r for r in out.collect()}


def test_resolve(spark):
    got = resolve(spark, [
        dict(staff_id="900123", matched_name="Test Kisi"),                                   # inactive centre
        dict(staff_id="4", matched_name="Eski Calisan"),                                     # namesake
        dict(staff_id="4", method="staff_id"),                                               # clean
        dict(staff_id="3", matched_name="Haritasiz Kisi"),                                   # unmapped
        dict(staff_id="2", doc_date=D(2026, 7, 9)),                                          # left, moved
        dict(staff_id="77"),                                                                 # secondary only
        dict(staff_id="zz"),                                                                 # unknown id
        dict(method="external", matched_name="Dis Kisi", norm="DIS KISI"),                   # ledger site
        dict(method="none", confidence=0.0, site_label="GPP Project"),                       # feed label, weak
        dict(method="extra", confidence=0.7, site_label="RHI"),                              # entity label only
        dict(staff_id="4", method="staff_id", site_label="Udokan (GMK)"),                    # project mismatch
        dict(staff_id="4", method="staff_id", site_label="RHI"),                             # entity, fine
        dict(staff_id="4", method="staff_id", site_label="Baska Yer"),                       # unknown label
        dict(staff_id="4", method="staff_id", reader_warning="fallback reader"),             # reader
        dict(staff_id="4", method="staff_id", doc_date=D(2026, 6, 5)),                       # before first, hired
    ])
    kinds = {i: [w.split(":")[0] for w in r["warnings"]] for i, r in got.items()}
    dec = {i: r["decision"] for i, r in got.items()}
    assert dec[2] == "AUTO" and kinds[2] == []
    assert kinds[0] == ["MAP"] and dec[0] == "REVIEW"
    assert kinds[1] == ["NAMESAKE"] and dec[1] == "REVIEW"
    assert kinds[3] == ["MAP"] and got[3]["cost_center"] == "Yeni Proje" and not got[3]["in_map"]
    assert got[3]["company"] == "RSS"
    assert kinds[4] == ["PERIOD", "LEFT"] and "Lytkarino" in got[4]["warnings"][0]
    assert kinds[5] == ["PERIOD", "MAP"] and got[5]["relation"] == "secondary" and got[5]["cost_center"] == "Lytkarino"
    assert dec[6] == "UNMATCHED" and got[6]["cost_center"] is None
    assert got[7]["cost_center"] == "GPP" and dec[7] == "REVIEW"
    assert got[8]["cost_center"] == "GPP" and dec[8] == "UNMATCHED"
    assert got[9]["cost_center"] is None and dec[9] == "UNMATCHED"
    assert kinds[10] == ["PROJECT"] and got[10]["label_class"] == "differs"
    assert kinds[11] == [] and got[11]["label_class"] == "entity"
    assert kinds[12] == ["LABEL"] and kinds[13] == ["READER"]
    assert got[14]["relation"] == "before_first" and "since" in got[14]["warnings"][0]
