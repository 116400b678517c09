import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendalloc.functions import text as T
from spendalloc.functions import values as P


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr("x").alias("v")).head()["v"]


FOLD = [
    ("ismail", "ISMAIL"), ("ığdır", "IGDIR"), ("şçöü", "SCOU"), ("", ""),
    ("İĞŞÇÖÜ", "IGSCOU"), ("ЩУКА ЖУКОВ ЧАЙ ЮРИЙ ЯНА", "SCHUKA ZHUKOV CHAY YURIY YANA"),
    ("Çıkış", "CIKIS"), ("Straße é ñ ø", "STRASSE E N "),
]
NORM = [
    ("  Özkan,  Mustafa-Kemal  ", "OZKAN MUSTAFA KEMAL"), ("ORNEKSOY/AHMETCA", "ORNEKSOY AHMETCA"),
    ("Yilmaz   Mehmet  ", "YILMAZ MEHMET"), ("", ""), (None, ""),
]
CLEAN = [
    ("CANER AKSU GRAND PLAZA HOTEL HANOI [11.07.2026] - [13.07.2026]  (2) KONAKLAMA YURTDISI", "CANER AKSU"),
    ("TK1234567890 ORNEKSOY/AHMETCAN MR  IST-CDG BILET BEDELI", "ORNEKSOY AHMETCAN"),
    ("PC1234567891 DEMIR MEHMET\\M  KYA-SAW-LED BILET BEDELI", "DEMIR MEHMET"),
    ("HALIT CAN KARADUMAN RUSYA FEDERASYONU TURISTIK E-VIZE", "HALIT CAN KARADUMAN"),
    ("EKSTRA BAGAJ UCRETI ALI MURAT SAHIN TARAFINDAN TASINDI", "ALI MURAT SAHIN"),
    ("[13.07.2026] - [14.07.2026] CENAZE CELENGI", ""), ("", ""),
]
TAIL = [
    ("OMER CAN CETIR KONSOLOSLUK UCRETI", "OMER CAN CETIR"),
    ("ALI GUNDOGDUTARAFINDAN", "ALI GUNDOGDU"), ("ALI VELI IKRAM BEDELI", "ALI VELI"),
    ("IKRAM YILMAZ", "IKRAM YILMAZ"), ("BILET ALI", ""), ("ALI IKRAM BEDELI", "ALI IKRAM"),
]
AMOUNTS = [
    ("2.500", "2500", "thousands_assumed"), ("1.234,56", "1234.56", None), ("1,234.56", "1234.56", None),
    ("(100)", "-100", None), ("100-", "-100", None), ("1.5e3", "1500", None), ("15.07.2026", None, None),
    ("2026-07-15", None, None), ("1.234.567", "1234567", None), ("0.500", "0.5", None),
    ("12.5", "12.5", None), ("36 000,00", "36000", None), ("1'234.50", "1234.5", None),
    ("EUR 12,5", "12.5", None), ("-", None, None), (None, None, None), ("abc", None, None),
    ("$ 5.211,77", "5211.77", None), ("-1e3", "-1000", None), ("1,234", "1.234", None), ("1,234,567", "1234567", None),
    ("1,23,4", None, None), ("0.123.456", "123456", None), ("-5,5", "-5.5", None), ("12-5", None, None), ("1,23457E+10", "12345700000", None),
]
DATES = [
    ("07/15/2026", dt.date(2026, 7, 15)), ("05/07/2026", dt.date(2026, 7, 5)),
    ("45000", dt.date(2023, 3, 15)), ("2026", None), ("22.05.2026", dt.date(2026, 5, 22)),
    ("2026-05-22", dt.date(2026, 5, 22)), ("15.07.2026 14:30", dt.date(2026, 7, 15)),
    ("2026-07-15T00:00:00", dt.date(2026, 7, 15)), ("July 15, 2026", dt.date(2026, 7, 15)),
    ("15 Jul 2026", dt.date(2026, 7, 15)), ("20260715", dt.date(2026, 7, 15)),
    ("1.2.99", dt.date(1999, 2, 1)), ("32.01.2026", None), ("abc", None), ("", None),
    ("2026/07/15", dt.date(2026, 7, 15)),
]


def many(spark, expr, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, x string").coalesce(1)
    return [r["v"] for r in df.select("i", expr("x").alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("expr,cases", [
    (T.fold, FOLD), (T.name_norm, NORM), (T.clean_person, CLEAN), (T.trim_tail, TAIL), (P.parse_date, DATES)])
def test_golden(spark, expr, cases):
    assert list(zip([c[0] for c in cases], many(spark, expr, [c[0] for c in cases]))) == cases


def test_amount(spark):
    got = many(spark, P.parse_amount, [c[0] for c in AMOUNTS])
    assert [(c[0], g["value"], g["note"]) for c, g in zip(AMOUNTS, got)] == [
        (raw, None if want is None else Decimal(want), note) for raw, want, note in AMOUNTS]


def test_names(spark):
    assert one(spark, T.token_key, "KEMAL SAHTEOGLU MUSTAFA KEMAL") == "KEMAL MUSTAFA SAHTEOGLU"
    assert one(spark, T.letter_sig, "KARADUMAN HALITCAN") == one(spark, T.letter_sig, "HALIT CAN KARADUMAN")
    assert one(spark, T.masculine, "NOVOSELOVA") == "NOVOSELOV"
    assert one(spark, T.masculine, "SHTEYNIKOVA") == "SHTEYNIKOV"
    assert one(spark, T.masculine, "MUSTAFA") is None
    assert one(spark, T.mask_id, "12345678901") == "123********"
    assert one(spark, T.status_norm, "Çıkış") == "Cikis"


@pytest.mark.parametrize("cat,text,want", [
    ("Bilet", "TK1234567890 SAHTEOGLU/MUSTAFAKEMAL MR  IST-CDG BILET BEDELI", ["SAHTEOGLU MUSTAFAKEMAL"]),
    ("Bilet", "VF1234567892 YAPAYSOY ARAS\\I  VKO-SAW-ESB-VKO BILET BEDELI", ["YAPAYSOY ARAS"]),
    ("Otel", "MUSTAFA KEMAL SAHTEOGLU ; POLINA PRIMEROVA GRAND HYATT ISTANBUL [10.07.2026] - [11.07.2026]  (1) KONAKLAMA YURTICI",
     ["MUSTAFA KEMAL SAHTEOGLU", "POLINA PRIMEROVA"]),
    ("Vize", "HALIT CAN KARADUMAN RUSYA FEDERASYONU TURISTIK E-VIZE", ["HALIT CAN KARADUMAN"]),
    ("Bagaj", "EKSTRA BAGAJ UCRETI ISA MUCAHIT SAHIN TARAFINDAN TASINDI", ["ISA MUCAHIT SAHIN"]),
    ("Diger", "[13.07.2026] - [14.07.2026] CENAZE CELENGI", []),
    ("Diger", "OMER CAN CETIR KONSOLOSLUK UCRETI", ["OMER CAN CETIR"]),
])
def test_persons(spark, cat, text, want):
    df = spark.createDataFrame([(cat, text)], "c string, x string")
    assert df.select(T.persons_of("c", "x").alias("v")).head()["v"] == want


@pytest.mark.parametrize("text,want", [
    ("RHI 1/3- RENSTROYDETAL 2/3", [("RHI", 1, 3), ("RENSTROYDETAL", 2, 3)]),
    ("GIRIS 10/07/2026", []), ("RHI 3/2", []), ("RHI 2/25", []), ("ODA 2/3 KISI", []), (None, []),
    ("UST LUGA 1/2", [("UST LUGA", 1, 2)]),
])
def test_shares(spark, text, want):
    assert [tuple(r) for r in one(spark, T.parse_shares, text)] == want


def test_routes(spark):
    assert one(spark, lambda c: T.direction(T.route(c)), "X ESB-VKO BILET") == "in"
    assert one(spark, lambda c: T.direction(T.route(c)), "X VKO-SAW-ESB") == "out"
    assert one(spark, lambda c: T.direction(T.route(c)), "IST-SAW") == "round"
    assert one(spark, lambda c: T.direction(T.route(c)), "otel") == "none"


def test_sites(spark):
    a = one(spark, T.site_key, "Ust-Luga – Reshetnikova Office")
    assert a == "UST LUGA RESHETNIKOVA OFFICE"
    assert one(spark, T.company_of, "renstroydetal") == "RSS"
    assert one(spark, T.is_entity, "RHI 1/3 - RENSTROYDETAL 2/3") is True
    assert one(spark, T.is_entity, "GPP Project") is False
    assert one(spark, T.is_entity, "R") is False


def test_ids(spark):
    assert one(spark, P.staff_id, " 632481.0 ") == "632481"
    assert one(spark, P.national_id, "1234 567 8901") == "12345678901"
    assert one(spark, P.national_id, "02345678901") is None
    assert one(spark, P.id_like, "RHI-1234") is True
    assert one(spark, P.id_like, "15.07.2026") is False
    assert one(spark, T.currency_key, "usd ") == "USD"
    assert one(spark, T.currency_key, None) == "?"
    assert one(spark, T.source_name, "mail.msg > ek.xlsx") == "ek.xlsx"
    assert one(spark, T.column_key, "ADI SOYADI\xa0\xa0") == "adi soyadi"


def test_money_marks(spark):
    got = one(spark, P.message_money, "$ 5.211,77")
    assert (got["value"], got["currency"]) == (Decimal("5211.77"), "USD")
    assert one(spark, P.message_money, "3.000,00 TL")["currency"] == "TRY"
    assert one(spark, P.message_money, "3.000,00") is None
