"""Small invented tables shared by the tests."""

import datetime as dt

SNAP_SCHEMA = (
    "staff_id string, full_name string, site string, period date, category string, company2 string, "
    "company string, status string, citizenship string, birth_date date, hire_date date, exit_date date, "
    "subcontract string, load_seq bigint")
LINE_SCHEMA = (
    "source_seq int, source_file string, source_type string, row_no bigint, doc_date date, description string, "
    "person_raw string, staff_id_raw string, national_id_raw string, amount decimal(18,6), currency string, "
    "site_label string, category string")


def snap(spark, rows):
    """rows: (staff_id, name, site, period[, dict of other columns])."""
    names = [f.split(" ")[0] for f in SNAP_SCHEMA.split(", ")]
    out = []
    for i, r in enumerate(rows):
        d = dict(staff_id=r[0], full_name=r[1], site=r[2], period=r[3], load_seq=i)
        if len(r) > 4:
            d.update(r[4])
        out.append(tuple(d.get(n) for n in names))
    return spark.createDataFrame(out, SNAP_SCHEMA)


def lines(spark, rows):
    """rows: dicts with any line columns."""
    names = [f.strip().split(" ")[0] for f in LINE_SCHEMA.split(",") if "18" not in f or "decimal" in f]
    names = ["source_seq", "source_file", "source_type", "row_no", "doc_date", "description", "person_raw",
             "staff_id_raw", "national_id_raw", "amount", "currency", "site_label", "category"]
    out = []
    for i, r in enumerate(rows):
        d = dict(source_seq=0, source_file="a.xlsx", source_type="travel_ledger", row_no=i + 1,
                 currency="USD", category="Bilet", description="")
        d.update(r)
        out.append(tuple(d.get(n) for n in names))
    return spark.createDataFrame(out, LINE_SCHEMA)


JUL = dt.date(2026, 7, 1)
