"""Views that give the driver tables the shape of expense data.

Every view has a Spark form and the same definition as SQL text, used by the
result check."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_norm
from ..functions.values import MONEY


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snap(spark, sf_dir) -> DataFrame:
    """Staff snapshots: per customer and month the last order priority as site."""
    o = load(spark, sf_dir, "orders")
    order = F.struct("o_orderdate", "o_orderkey")
    s = o.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("period")).agg(
        F.max_by("o_orderpriority", order).alias("site"), F.max_by("o_orderstatus", order).alias("company2"))
    c = load(spark, sf_dir, "customer")
    s = s.join(c.select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    none = F.lit(None)
    return s.select(
        F.col("o_custkey").cast("string").alias("staff_id"), F.col("c_name").alias("full_name"), "site", "period",
        F.lit("Aktif").alias("category"), "company2", F.col("c_mktsegment").alias("company"),
        none.cast("string").alias("status"), none.cast("string").alias("citizenship"),
        none.cast("date").alias("birth_date"), none.cast("date").alias("hire_date"),
        none.cast("date").alias("exit_date"), none.cast("string").alias("subcontract"),
        F.col("o_custkey").alias("load_seq"))


SNAP = """
v_snap AS (
  SELECT CAST(o_custkey AS VARCHAR) AS staff_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS site,
         arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS company2
  FROM orders GROUP BY 1, 2)"""


def line(spark, sf_dir) -> DataFrame:
    """Expense lines: order lines of the customer, dated by shipment."""
    l = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag",
        "l_linestatus", "l_shipdate")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")
    return j.select(
        F.lit(0).alias("source_seq"), row.alias("row_no"),
        F.concat(F.lit("mail > feed "), "o_orderstatus").alias("source_file"),
        F.lit("travel_ledger").alias("source_type"),
        F.col("o_custkey").cast("string").alias("staff_id"), F.col("l_shipdate").cast("date").alias("doc_date"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"), F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("currency"), "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey",
        "o_orderpriority")


LINE = """
v_line AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey AS row_no,
         'feed ' || o_orderstatus AS feed, CAST(o_custkey AS VARCHAR) AS staff_id,
         CAST(l_shipdate AS DATE) AS doc_date, CAST(l_extendedprice AS DECIMAL(18,6)) AS amount,
         l_returnflag AS category, l_linestatus AS currency, l_linenumber, l_partkey, l_suppkey, l_orderkey,
         o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ASOF = """
v_last AS (SELECT max(period) AS last_period FROM v_snap),
v_first AS (SELECT staff_id, arg_min(site, period) AS f_site, min(period) AS f_period,
                   arg_min(company2, period) AS f_company2 FROM v_snap GROUP BY 1),
v_asof AS (
  SELECT l.*, coalesce(s.site, f_site) AS site, coalesce(s.period, f_period) AS period,
         coalesce(s.company2, f_company2) AS company2,
         CASE WHEN f_period IS NULL THEN NULL WHEN s.period IS NULL THEN 'before_first'
              WHEN date_trunc('month', l.doc_date) = date_trunc('month', s.period) THEN 'same_month'
              WHEN date_trunc('month', l.doc_date) > last_period THEN 'roster_stale' ELSE 'earlier' END AS relation
  FROM v_line l ASOF LEFT JOIN v_snap s ON l.staff_id = s.staff_id AND l.doc_date >= s.period
  LEFT JOIN v_first f ON l.staff_id = f.staff_id CROSS JOIN v_last)"""


def cmap(spark, sf_dir) -> DataFrame:
    """Centre map: five of the sites by priority name, company from the region."""
    r = load(spark, sf_dir, "region")
    n = load(spark, sf_dir, "nation")
    sites = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site")).distinct()
    # Priority i stands for nation i-1; the lowest priority is left out and stays unmapped.
    s = sites.withColumn("i", F.left("site", F.lit(1)).cast("int") - 1).filter("i < 4")
    j = s.join(n, F.col("i") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("site", F.concat(F.lit("CC-"), "n_name").alias("code"), F.col("n_name").alias("name"),
                    F.col("r_name").alias("company"), (F.col("i") != 3).alias("active"),
                    F.col("i").alias("load_seq"))


CMAP = """
v_map AS (
  SELECT site, 'CC-' || n_name AS code, n_name AS name, r_name AS company, i <> 3 AS active, i AS load_seq
  FROM (SELECT DISTINCT o_orderpriority AS site, CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS i FROM orders)
  JOIN nation ON i = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE i < 4)"""


# --- names -------------------------------------------------------------------

# The letters that occur in the documents, spelled out; not the database's accent function.
FOLD_SQL = "translate(upper(replace({0}, 'ß', 'ss')), 'ÉÓÈÑÇÜÊÄÖÍ', 'EOENCUEAOI')"


def fold_sql(x: str) -> str:
    return f"regexp_replace({FOLD_SQL.format(x)}, '[^\\x00-\\x7F]', '', 'g')"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace({fold_sql(x)}, '[^A-Z]+', ' ', 'g'))"


TKEY_SQL = "array_to_string(list_sort(list_distinct(string_split({0}, ' '))), ' ')"
SIG_SQL = "array_to_string(list_sort(string_split(replace({0}, ' ', ''), '')), '')"


#: Names of one document are numbered from its id times this on.
NAMES = 1_000_000


def roster(spark, sf_dir, deal: bool = False) -> DataFrame:
    """Name roster: the words of a whole document, three by three, are the names of its persons, each once.

    A compressed file of texts unfolds into many names but is read by few tasks;
    with `deal`, documents are dealt out before, and later steps have as many."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    d = d.repartition("doc_id") if deal else d
    threes = F.split(F.regexp_replace(name_norm("text"), "([A-Z]+ [A-Z]+ [A-Z]+) ", "$1\n"), "\n")
    d = d.select("doc_id", "source", "lang", "n_chars", F.posexplode(F.array_distinct(threes)).alias("i", "full_name"))
    number = F.col("doc_id") * NAMES + F.col("i")
    return d.select(
        number.cast("string").alias("staff_id"), "full_name",
        F.col("source").alias("site"), F.lit("2026-07-01").cast("date").alias("period"),
        F.lit("Aktif").alias("category"), F.col("lang").alias("company2"), F.col("lang").alias("company"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("citizenship"),
        F.date_add(F.lit("1970-01-01").cast("date"),
                   F.pmod(F.col("n_chars") + 37 * F.col("i"), F.lit(9000)).cast("int")).alias("birth_date"),
        F.lit(None).cast("date").alias("hire_date"), F.lit(None).cast("date").alias("exit_date"),
        F.lit(None).cast("string").alias("subcontract"), number.alias("load_seq"), "n_chars")


ROSTER = f"""
v_threes AS (
  SELECT doc_id AS doc, source, lang, n_chars, i, array_to_string(w[3 * i + 1:3 * i + 3], ' ') AS norm
  FROM (SELECT *, unnest(range((len(w) + 2) // 3)) AS i
        FROM (SELECT doc_id, source, lang, n_chars, string_split({norm_sql('text')}, ' ') AS w FROM documents))),
v_each AS (
  SELECT doc, source, lang, n_chars, norm, row_number() OVER (PARTITION BY doc ORDER BY min(i)) - 1 AS n
  FROM v_threes GROUP BY doc, source, lang, n_chars, norm),
v_roster AS (
  SELECT doc * {NAMES} + n AS doc_id, CAST(doc * {NAMES} + n AS VARCHAR) AS staff_id, source AS site, lang,
         DATE '1970-01-01' + CAST((n_chars + 37 * n) % 9000 AS INTEGER) AS birth_date, norm
  FROM v_each)"""


def mention(spark, sf_dir, r: DataFrame = None) -> DataFrame:
    """Invoice names: roster names altered by their number, six ways."""
    r = roster(spark, sf_dir) if r is None else r
    w, n = F.split("full_name", " "), F.size(F.split("full_name", " "))
    k = F.pmod("load_seq", F.lit(6))
    last, before = F.element_at(w, -1), F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0)))
    head = F.array_join(before, " ")
    text = (
        F.when(k == 0, F.col("full_name"))
        .when(k == 1, F.array_join(F.reverse(w), " "))
        .when(k == 2, head)
        .when(k == 3, F.concat(F.array_join(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), " "), F.lit(" "),
                               F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("")), last))
        .when(k == 4, F.concat(head, F.lit(" "), F.left(last, F.greatest(F.length(last) - 2, F.lit(4)))))
        .otherwise(F.concat(F.left("full_name", F.length("full_name") - 1), F.lit("Q")))
    )
    return r.select(
        F.lit(1).alias("source_seq"), F.concat(F.lit("invoice "), "site").alias("source_file"),
        F.lit("travel_ledger").alias("source_type"), F.col("load_seq").alias("row_no"),
        F.col("period").alias("doc_date"), F.lit("").alias("description"), F.trim(text).alias("person_raw"),
        F.lit(None).cast("string").alias("staff_id_raw"), F.lit(None).cast("string").alias("national_id_raw"),
        F.col("n_chars").cast(MONEY).alias("amount"), F.lit("USD").alias("currency"),
        F.col("site").alias("site_label"),
        F.when(k.isin(0, 3), "Bilet").otherwise("Otel").alias("category"), "birth_date")


MENTION = """
v_words AS (SELECT *, string_split(norm, ' ') AS w, len(string_split(norm, ' ')) AS n, doc_id % 6 AS k FROM v_roster),
v_mention AS (
  SELECT doc_id, birth_date, site, CASE WHEN k IN (0, 3) THEN 'Bilet' ELSE 'Otel' END AS category,
    trim(CASE k WHEN 0 THEN norm WHEN 1 THEN array_to_string(list_reverse(w), ' ')
      WHEN 2 THEN array_to_string(w[1:n-1], ' ')
      WHEN 3 THEN coalesce(array_to_string(CASE WHEN n > 2 THEN w[1:n-2] END, ' '), '') || ' ' || coalesce(CASE WHEN n > 1 THEN w[n-1] END, '') || w[n]
      WHEN 4 THEN array_to_string(w[1:n-1], ' ') || ' ' || left(w[n], greatest(length(w[n]) - 2, 4))
      ELSE left(norm, length(norm) - 1) || 'Q' END) AS mnorm
  FROM v_words)"""


# --- two feeds of the same payments -------------------------------------------

def copies(spark, sf_dir) -> DataFrame:
    """Orders as a raw feed, and its manually distributed copy.

    By the order number the copy drops a row, flips the sign, changes the
    amount by one, loses the date, or keeps the row."""
    o = load(spark, sf_dir, "orders")
    date = F.col("o_orderdate").cast("date")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast(MONEY)
    person = F.concat(F.lit("P "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "ABCDEFGHIJ"))
    base = lambda seq, file, kind, d, a: (
        F.lit(seq).alias("source_seq"), F.col("o_orderkey").alias("row_no"), F.lit(file).alias("source_file"),
        F.lit(kind).alias("source_type"), d.alias("doc_date"), person.alias("person_raw"), a.cast(MONEY).alias("amount"),
        F.col("o_orderstatus").alias("currency"), F.lit("Bilet").alias("category"), F.lit(None).cast("string").alias("site_label"),
        F.col("o_orderpriority").alias("cost_center"), F.col("o_orderpriority").alias("cost_center_name"),
        F.lit(True).alias("in_map"), F.lit("RHI").alias("company"), F.lit(None).cast("string").alias("company2"),
        F.col("o_custkey").cast("string").alias("staff_id"), F.lit("AUTO").alias("decision"),
        F.lit(None).cast("array<struct<label:string,num:int,den:int>>").alias("shares"))
    k = F.pmod("o_orderkey", F.lit(10))
    raw = o.select(*base(0, "raw.xls", "travel_ledger", date, amount))
    copy = o.filter(k != 0).select(*base(
        1, "copy.xlsx", "distributed", F.when(k != 3, date),
        F.when(k == 1, -amount).when(k == 2, amount + 1).otherwise(amount)))
    return raw.unionByName(copy)


COPIES = """
v_raw AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS doc_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         o_orderstatus AS ccy, o_custkey, 'P ' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS person,
         array_to_string(list_sort(string_split('P' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ'), '')), '') AS sig,
         o_orderpriority AS cost_center
  FROM orders),
v_copy AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN doc_date END AS doc_date,
         CAST(CASE o_orderkey % 10 WHEN 1 THEN -amount WHEN 2 THEN amount + 1 ELSE amount END AS DECIMAL(18,2)) AS amount,
         ccy, o_custkey, person, sig, cost_center
  FROM v_raw WHERE o_orderkey % 10 <> 0)"""


def with_sql(query: str, *views: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views) + " " + query.strip()


def with_ctes(query: str, *views: str) -> str:
    """Views followed by further named subqueries and the final select."""
    return "WITH " + ",".join(v.strip() for v in views) + ", " + query.strip()
