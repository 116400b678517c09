import datetime as dt
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from spendalloc.functions import vocab as V
from spendalloc.sources import cells as K
from spendalloc.sources import dims, feeds, kinds, sinks


def test_read_feeds(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Ad Soyad;Tutar\nIşık Çağ;1.234,56\n\"x;y\";2\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("Ad Soyad,Tutar\nIşık Çağ,5\n".encode("cp1254"))
    got = {(r["file"], r["row"]): r["cells"] for r in feeds.read_feeds(spark, str(tmp_path)).collect()}
    assert got[("a.csv", 1)] == ["Işık Çağ", "1.234,56"] and got[("a.csv", 2)] == ["x;y", "2"]
    assert got[("b.csv", 1)] == ["Işık Çağ", "5"]
    h = feeds.file_hashes(spark, str(tmp_path)).count()
    assert h == 2


def grid(spark, sheets):
    rows = [(seq, file, sheet, i, [None if c is None else str(c) for c in row])
            for seq, file, sheet, body in sheets for i, row in enumerate(body)]
    return K.to_cells(spark.createDataFrame(rows, "source_seq int, file string, sheet string, row int, cells array<string>"))


@pytest.fixture(scope="module")
def book(spark):
    body = [["ALI VELI", "900%d" % i, "1111111111%d" % i, "1.234,56", "01.07.2026", "GPP"] for i in range(3)]
    return grid(spark, [
        (1, "list.xlsx", "kisi", [["Baslik"], ["Adı Soyadı", "Sicil No", "TC Kimlik No", "Tutar (USD)", "Fatura Tarihi", "Proje Adı"], *body,
                                  ["TOPLAM USD", None, None, "99", None, None]]),
        (2, "odd.xlsx", "s", [["Isim", "Kodu", "Provider", "Bedel EUR"], ["CAN TEK", "SK-GPP", "x", "5"], ["ECE SU", "AB.CD", "y", "6"]]),
        (3, "pivot.xlsx", "p", [["Count of PERSONEL", "Row Labels"], ["a", "1"]]),
        (4, "cari.xls", "c", [["Cari Hareket Dokumu"], ["Islem Tarihi", "Aciklama", "Borc"], ["x", "y", "1"]]),
        (5, "kutuk.xlsx", "k", [["Sicil No", "Masraf Merkezi", "Ad Soyad"], ["900001", "GPP", "ALI VELI"]]),
    ]).cache()


def test_headers_and_columns(spark, book):
    h = K.header_rows(book)
    assert {r["source_seq"]: r["header_row"] for r in h.collect()}[1] == 1
    kept = K.drop_pivot_sheets(book, h)
    assert kept.filter("source_seq = 3").count() == 0
    r = K.validate_id_columns(book, K.resolve_columns(K.column_keys(book, h), K.synonym_table(spark)))
    got = {(x["source_seq"], x["field"]): x["key"] for x in r.collect()}
    assert got[(1, "person")] == "adi soyadi" and got[(1, "staff_id")] == "sicil no"
    assert got[(1, "national_id")] == "tc kimlik no" and got[(1, "doc_date")] == "fatura tarihi"
    assert (2, "staff_id") not in got and got[(2, "amount")] == "bedel eur"
    rep = {x["source_seq"]: x for x in K.column_report(r, h).collect()}
    assert rep[1]["usable"] and "currency" in rep[1]["missing"]
    types = {x["source_seq"]: x["types"] for x in K.classify_feeds(book, h, r).collect()}
    assert types[4][0] == V.TRAVEL_LEDGER and types[5][0] == V.REFERENCE_LIST and types[1] == [V.GENERIC]


def test_user_synonym_first(spark):
    c = grid(spark, [(1, "f", "s", [["Musteri", "Isim"], ["ALI VELI", "x y"]])])
    user = spark.createDataFrame([("person", "Müşteri", 0)], "field string, synonym string, load_seq int")
    r = K.resolve_columns(K.column_keys(c, K.header_rows(c)), K.synonym_table(spark, user))
    assert [x["key"] for x in r.filter("field = 'person'").collect()] == ["musteri"]


def test_to_lines(spark, book):
    h = K.header_rows(book)
    r = K.validate_id_columns(book, K.resolve_columns(K.column_keys(book, h), K.synonym_table(spark)))
    lines = {(x["source_seq"], x["row_no"]): x for x in K.to_lines(book, h, r).collect()}
    one = lines[(1, 3)]
    assert (one["amount"], one["currency"], one["staff_id_raw"]) == (Dec("1234.56"), "USD", "9000")
    assert one["doc_date"] == dt.date(2026, 7, 1) and one["site_label"] == "GPP"
    assert (1, 6) not in lines
    assert lines[(2, 2)]["currency"] == "EUR" and "provider" in lines[(2, 2)]["raw_columns"]


def test_repeat_sheets(spark):
    rows = [("big", i) for i in range(30)] + [("part", i) for i in range(25)] + [("other", 100 + i) for i in range(20)]
    df = spark.createDataFrame([(1, s, str(k), None, None, n) for n, (s, k) in enumerate(rows)],
                               "source_seq int, sheet string, staff_id_raw string, national_id_raw string, person_raw string, row_no int")
    got = {r["sheet"]: r["repeats"] for r in K.mark_repeat_sheets(df).collect()}
    assert got == {"big": None, "part": "big", "other": None}


def test_dims(spark):
    m, issues = dims.load_map(spark.createDataFrame(
        [("GPP Project", "GPP", None, "rhi", "E", 1), ("GPP  project", "X", None, "rhi", "H", 2), ("Udokan", "GPP Project", "U", "rhi", None, 3)],
        "site string, code string, name string, company string, active string, load_seq int"))
    assert {(r["issue"], r["site"]) for r in issues.collect()} == {("duplicate_site", "GPP project"), ("shadowed", "Udokan")}
    assert [r["active"] for r in m.orderBy("load_seq").collect()] == [True, False, True]
    s = dims.load_snapshots(spark.createDataFrame(
        [("900123.0", "Test Kisi", "GPP", "01.07.2026", "Çıkış"), (None, "X", "GPP", None, None)],
        "Sicil string, `Ad Soyad` string, `Görev Yeri` string, `Dönem` string, Kategori string")).collect()
    assert [(r["staff_id"], r["period"], r["category"]) for r in s] == [("900123", dt.date(2026, 7, 1), "Cikis")]
    with pytest.raises(ValueError):
        dims.load_snapshots(spark.createDataFrame([("1",)], "x string"))
    sec = dims.load_secondary(spark.createDataFrame(
        [("1", "Ali Veli", "Cikis", 1), ("2", "Can Tek", None, 2), ("2", "Baska", None, 3)],
        "staff_id string, full_name string, category string, load_seq int"))
    assert {r["staff_id"]: r["norm"] for r in sec.collect()} == {"1": "", "2": "CAN TEK"}
    led = dims.load_ledger(spark.createDataFrame([("ali  veli", "1", 1), ("Ali Veli", "2", 2), ("", "3", 3)],
                                                 "name_norm string, staff_id string, load_seq int"), "alias")
    assert [(r["name_norm"], r["staff_id"]) for r in led.collect()] == [("ALI VELI", "2")]


def test_layouts(spark):
    dist = spark.createDataFrame(
        [(1, "d", 2, "1", "01.07.2026", "CANER AKSU", "201,42", "IST-LED", None, "RHI 1/3- RENSTROYDETAL 2/3", []),
         (1, "d", 3, None, None, "TOPLAM TUTAR", "9", None, None, None, [])],
        "source_seq int, source_file string, row_no int, number string, doc_date string, description string, amount string, "
        "route string, flight string, site_label string, notes array<string>")
    r = kinds.distributed_lines(dist).collect()
    assert len(r) == 1 and r[0]["category"] == "Bilet" and r[0]["person_raw"] == "CANER AKSU"
    assert [tuple(s) for s in r[0]["shares"]] == [("RHI", 1, 3), ("RENSTROYDETAL", 2, 3)]
    reg = kinds.register_lines(spark.createDataFrame(
        [(1, "h", 2, "Ali Veli", "11111111111", "05.05.1990")],
        "source_seq int, source_file string, row_no int, person string, national_id string, birth_date string"), V.HEALTH).head()
    assert reg["birth_date"] == dt.date(1990, 5, 5) and reg["amount"] is None
    bad = kinds.summary_items(spark.createDataFrame(
        [(1, "premium\n$ 2,75\npremium\n$ 1,95\n"), (2, "AA\n$ 1,00\nBB\n$ 2,00\nTOPLAM\n$ 4,00\n")], "msg_id int, text string")).collect()
    assert {(r["msg_id"], r["label"], r["agrees"]) for r in bad} == {(2, "AA", False), (2, "BB", False)}


def test_message_items_are_searched_once(spark):
    """Rules over labels and currencies hold, rows of one id count as one message, and texts are searched once."""
    texts = [(1, "AA\n$ 1,00\nBB\n$ 2,00\nTOPLAM\n$ 3,00\n"), (2, "AA\n$ 1,00\nBB\n€ 2,00\n"),
             (3, "AA\n$ 1,00\n"), (3, "BB\n$ 5,00\nTotal\n$ 6,00\n"), (4, "AA\n$ 1,00\n"), (4, "aa\n$ 1,00\n"),
             (5, "AA\n€ 1,00\nBB\n€ 2,00\nCC\n€ 2,00\n"), (6, None), (None, "AA\n$ 1,00\nBB\n$ 2,00\n"),
             (7, "AA\n$ 1,00\nBB\n$ 2,00\nTOTAL\n$ 9,00\nTOPLAM\n₺ 3,00\n"), (8, "AA\n$ 1,00\naa\n€ 1,00\nBB\n$ 1,00\n")]
    out = kinds.summary_items(spark.createDataFrame(texts, "msg_id int, text string"))
    assert "regexp_extract_all" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["msg_id"], r["label"], r["amount"], r["currency"], r["declared"], r["agrees"]) for r in out.collect())
    assert got == [
        (1, "AA", Dec(1), "USD", Dec(3), True), (1, "BB", Dec(2), "USD", Dec(3), True),
        (3, "AA", Dec(1), "USD", Dec(6), True), (3, "BB", Dec(5), "USD", Dec(6), True),
        (5, "AA", Dec(1), "EUR", None, True), (5, "BB", Dec(2), "EUR", None, True), (5, "CC", Dec(2), "EUR", None, True),
        (7, "AA", Dec(1), "USD", Dec(9), False), (7, "BB", Dec(2), "USD", Dec(9), False)]


def test_sinks(spark, tmp_path):
    assert len(sinks.LINE_COLUMNS) == 28 and len(sinks.ALLOCATION_COLUMNS) == 18
    rows = spark.createDataFrame(
        [("f", "Bilet", V.UNALLOCATED, "", "USD", "", Dec("10.00"), 2, 1, 0, 1, 1, dt.date(2026, 6, 1), dt.date(2026, 7, 1), None, False, None, None)],
        "feed string, category string, cost_center string, company string, currency string, share_note string, amount decimal(18,2), "
        "n_lines long, n_persons long, n_auto long, n_review long, n_unmatched long, first_date date, last_date date, "
        "cost_center_name string, in_map boolean, labels string, doc_numbers string")
    sinks.export_allocation(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "out")).head()
    assert back["status"] == "NO CENTRE | 1 unmatched | 1 to review" and back["period"] == "06.2026 - 07.2026"
