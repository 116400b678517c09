"""Roster, map and ledger tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_norm, site_key, status_norm, token_key
from ..functions.values import cell_text, national_id, parse_date, staff_id
from ..functions.vocab import TRUE_MARKS

# field -> header keys that may carry it
SNAPSHOT_COLUMNS = {
    "staff_id": ("sicil", "sicil no", "staff_id", "id"), "full_name": ("ad soyad", "adi soyadi", "full_name", "isim"),
    "site": ("gorev yeri", "site", "proje"), "period": ("donem", "period"),
    "category": ("kategori", "category"), "company2": ("sirket 2", "sirket2", "company2"),
    "company": ("sirket", "company"), "status": ("statu", "status"),
    "citizenship": ("vatandaslik", "uyruk", "citizenship"), "birth_date": ("dogum tarihi", "birth_date"),
    "hire_date": ("ise giris tarihi", "hire_date"), "exit_date": ("cikis tarihi", "exit_date"),
    "subcontract": ("taseron", "subcontract"),
}
_DATES = ("period", "birth_date", "hire_date", "exit_date")


def _pick(df: DataFrame, names) -> str:
    """First column of df whose normalised name is one of names."""
    plain = {}
    for c in df.columns:
        plain.setdefault(" ".join(c.lower().replace("_", " ").translate(str.maketrans("ıİşğçöü", "iisgcou")).split()), c)
    return next((plain[n.replace("_", " ")] for n in names if n.replace("_", " ") in plain), None)


def load_snapshots(df: DataFrame) -> DataFrame:
    """Typed staff snapshots. Rows without id are dropped, rows without name stay for id lookup."""
    cols, missing = {}, []
    for field, names in SNAPSHOT_COLUMNS.items():
        c = _pick(df, names)
        if c is None:
            if field in ("staff_id", "full_name", "site", "period"):
                missing.append(field)
            cols[field] = F.lit(None).cast("date" if field in _DATES else "string")
        elif field in _DATES:
            cols[field] = F.col(c).cast("date") if dict(df.dtypes)[c] in ("date", "timestamp") else parse_date(c)
        else:
            cols[field] = cell_text(c)
    if missing:
        raise ValueError("staff table lacks columns: " + ", ".join(missing))
    seq = F.col("load_seq") if "load_seq" in df.columns else F.monotonically_increasing_id()
    out = df.select(*[e.alias(n) for n, e in cols.items()], seq.alias("load_seq"))
    return out.withColumns({"staff_id": staff_id("staff_id"), "category": status_norm("category")}).filter(
        F.col("staff_id").isNotNull())


def load_secondary(df: DataFrame, excluded=("Cikis",)) -> DataFrame:
    """Undated roster, first row per id; excluded categories and blank names have no name key."""
    f = df.withColumn("staff_id", staff_id("staff_id")).filter(F.col("staff_id").isNotNull())
    rest = [c for c in f.columns if c != "staff_id"]
    one = f.groupBy("staff_id").agg(F.min_by(F.struct(*rest), "load_seq").alias("r")).select("staff_id", "r.*")
    out = F.col("category").isin(*excluded) if "category" in one.columns else F.lit(False)
    one = one.withColumn("norm", F.when(~F.coalesce(out, F.lit(False)), name_norm("full_name")).otherwise(""))
    return one.withColumn("tkey", token_key("norm"))


def load_map(df: DataFrame):
    """(map, issues). Code and name default to the site; of equal sites the first row counts.

    Issues: duplicate sites, and codes or names that read like another row's site."""
    text = lambda c: cell_text(c)
    mark = F.upper(F.coalesce(F.col("active").cast("string"), F.lit("E")))
    m = df.withColumn("site", text("site")).filter(F.col("site").isNotNull()).select(
        "site", F.coalesce(text("code"), F.col("site")).alias("code"), F.coalesce(text("name"), F.col("site")).alias("name"),
        F.upper(text("company")).alias("company"), ((mark == "") | mark.isin(*TRUE_MARKS)).alias("active"), "load_seq")
    keyed = m.withColumn("key", site_key("site"))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("load_seq", "site"), "load_seq").alias("f"))
    twice = keyed.join(first, "key").filter(F.col("load_seq") != F.col("f.load_seq")).select(
        F.lit("duplicate_site").alias("issue"), "site", F.col("f.site").alias("other"))
    alias = keyed.select("site", "load_seq", F.col("key").alias("own"), F.explode(F.array("code", "name")).alias("alias"))
    alias = alias.withColumn("key", site_key("alias")).filter(F.col("key") != F.col("own"))
    shadow = alias.join(first, "key").select(
        F.lit("shadowed").alias("issue"), "site", F.col("f.site").alias("other")).distinct()
    return m, twice.unionByName(shadow)


LEDGERS = {
    "alias": ("name_norm", ["name_norm", "staff_id", "full_name", "source", "load_seq"]),
    "external": ("name_norm", ["name_norm", "full_name", "organisation", "cost_center", "note", "source", "load_seq"]),
    "extra": ("key", ["key", "national_id", "full_name", "site", "source", "load_seq"]),
    "bridge": ("national_id", ["national_id", "staff_id", "full_name", "source", "load_seq"]),
}


def load_ledger(df: DataFrame, kind: str) -> DataFrame:
    """Normalised keys, last row per key."""
    key, cols = LEDGERS[kind]
    d = df
    for c in cols:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    if kind in ("alias", "external"):
        own = name_norm("name_norm")
        d = d.withColumn("name_norm", F.when(own != "", own).otherwise(name_norm("full_name")))
    if "staff_id" in cols:
        d = d.withColumn("staff_id", staff_id("staff_id")).filter(F.col("staff_id").isNotNull())
    if "national_id" in cols:
        d = d.withColumn("national_id", national_id("national_id", strict=False))
    if kind == "extra":
        d = d.withColumn("key", F.coalesce("national_id", F.nullif(name_norm("full_name"), F.lit("")), F.nullif(name_norm("key"), F.lit(""))))
    d = d.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    rest = [c for c in cols if c != key]
    return d.groupBy(key).agg(F.max_by(F.struct(*rest), "load_seq").alias("r")).select(key, "r.*")


def load_ledgers(spark, path: str):
    """The four ledgers of a folder, plus a table of how many rows each loaded.

    `short` marks a ledger of which under half of the rows were usable."""
    out, counts = {}, None
    for kind in LEDGERS:
        raw = spark.read.parquet(f"{path.rstrip('/')}/{kind}")
        out[kind] = load_ledger(raw, kind)
        row = raw.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(kind).alias("ledger"), "n_rows").join(
            out[kind].agg(F.count(F.lit(1)).alias("n_loaded")), F.lit(True))
        counts = row if counts is None else counts.unionByName(row)
    # Extra persons are also found by name: one more key row each.
    return out, counts.withColumn("short", F.col("n_loaded") * 2 < F.col("n_rows"))
