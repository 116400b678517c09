"""Queries over as-of, centres, shares, duplicates and reconciliation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import CENTS, cents
from ..operators import allocate as A
from ..operators import asof, centers, dedup, reconcile
from ..operators.common import cut_lineage
from . import views as V

_SHARES = "array<struct<label:string,num:int,den:int>>"


# --- as-of and centres -------------------------------------------------------

def asof_site(spark, d) -> DataFrame:
    """Money per feed, currency, site and relation in the month of the expense."""
    out = asof.as_of(V.line(spark, d), V.snap(spark, d).select("staff_id", "period", "site", "load_seq"))
    from ..functions.text import source_name
    return out.groupBy(source_name("source_file").alias("feed"), "currency", "site", "relation").agg(
        F.count(F.lit(1)).alias("n_lines"), cents(F.sum("amount")).alias("amount"))


ASOF_SITE = V.with_sql("""
SELECT feed, currency, site, relation, count(*) AS n_lines, CAST(sum(amount) AS DECIMAL(18,2)) AS amount
FROM v_asof GROUP BY ALL""", V.SNAP, V.LINE, V.ASOF)


def latest_site(spark, d) -> DataFrame:
    """Newest roster row per id."""
    from ..operators.roster import latest
    return latest(V.snap(spark, d)).select("staff_id", "period", "site", "company2")


LATEST_SITE = V.with_sql("""
SELECT staff_id, max(period) AS period, arg_max(site, period) AS site, arg_max(company2, period) AS company2
FROM v_snap GROUP BY 1""", V.SNAP)


def _matched(spark, d) -> DataFrame:
    """Lines as the cascade leaves them: the id is given, so the match is certain."""
    l = V.line(spark, d)
    # Every 13th id is unknown to the roster, every 7th line has no id at all.
    return l.withColumns({
        "matched_name": F.lit(None).cast("string"), "method": F.lit("staff_id"),
        "confidence": F.when(F.col("l_linenumber") == 7, 0.0).when(F.col("l_linenumber") == 6, 0.75).otherwise(1.0),
        "norm": F.lit(""), "nid": F.lit(""),
        "staff_id": F.when(F.col("l_linenumber") != 7, F.col("staff_id")),
        "site_label": F.when(F.col("l_linenumber") == 7, F.col("o_orderpriority"))
                       .when(F.col("l_linenumber") == 1, F.col("o_orderpriority")).when(F.col("l_linenumber") == 2, "RHI")})


def resolved(spark, d) -> DataFrame:
    return centers.resolve_lines(_matched(spark, d), V.snap(spark, d), V.cmap(spark, d), synonyms={})


def center_resolve(spark, d) -> DataFrame:
    """Centre, label class and decision of every line, counted."""
    r = resolved(spark, d)
    return r.groupBy("cost_center", "in_map", "company", "relation", "origin", "label_class", "decision").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("warnings")).alias("n_warnings"),
        cents(F.sum("amount")).alias("amount"))


_RESOLVED = """
v_ids AS (
  SELECT a.*, CASE WHEN l_linenumber <> 7 THEN staff_id END AS sid,
         CASE l_linenumber WHEN 7 THEN 0.0 WHEN 6 THEN 0.75 ELSE 1.0 END AS confidence,
         CASE l_linenumber WHEN 7 THEN o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN 'RHI' END AS site_label
  FROM v_asof a),
v_res AS (
  SELECT i.*, CASE WHEN sid IS NULL THEN site_label ELSE i.site END AS site_text,
         coalesce(m.code, CASE WHEN sid IS NULL THEN site_label ELSE i.site END) AS cost_center,
         m.code IS NOT NULL AS hit, m.company AS map_company, coalesce(NOT m.active, false) AS inactive,
         lm.code AS label_code
  FROM v_ids i LEFT JOIN v_map m ON m.site = CASE WHEN sid IS NULL THEN site_label ELSE i.site END
  LEFT JOIN v_map lm ON lm.site = site_label),
v_lab AS (
  SELECT *, CASE WHEN sid IS NULL THEN CASE WHEN site_label IS NULL THEN 'none' ELSE 'agrees' END
      WHEN site_label IS NULL THEN 'none' WHEN site_label = 'RHI' THEN 'entity'
      WHEN label_code IS NULL THEN CASE WHEN site_label = site THEN 'agrees' ELSE 'unknown' END
      WHEN label_code = cost_center THEN 'agrees' ELSE 'differs' END AS label_class
  FROM v_res),
v_out AS (
  SELECT *, CASE WHEN sid IS NULL THEN 'none' ELSE relation END AS rel,
    (CASE WHEN sid IS NOT NULL AND relation <> 'same_month' THEN 1 ELSE 0 END)
    + (CASE WHEN inactive THEN 1 ELSE 0 END) + (CASE WHEN NOT hit THEN 1 ELSE 0 END)
    + (CASE WHEN sid IS NOT NULL AND label_class IN ('differs', 'unknown') THEN 1 ELSE 0 END)
    + (CASE WHEN sid IS NULL THEN 1 ELSE 0 END) AS nw
  FROM v_lab),
v_dec AS (
  SELECT *, CASE WHEN confidence < 0.5 OR cost_center IS NULL THEN 'UNMATCHED'
                 WHEN confidence >= 0.9 AND nw = 0 THEN 'AUTO' ELSE 'REVIEW' END AS decision,
         coalesce(map_company, CASE WHEN sid IS NOT NULL THEN company2 END) AS company,
         CASE WHEN sid IS NULL THEN true ELSE hit END AS in_map,
         CASE WHEN sid IS NULL THEN 'feed' ELSE 'roster' END AS origin
  FROM v_out)"""
RESOLVED = (V.SNAP, V.LINE, V.ASOF, V.CMAP, _RESOLVED)
CENTER_RESOLVE = V.with_sql("""
SELECT cost_center, in_map, company, rel AS relation, origin, label_class, decision, count(*) AS n_lines,
       CAST(sum(nw) AS BIGINT) AS n_warnings, CAST(sum(amount) AS DECIMAL(18,2)) AS amount
FROM v_dec GROUP BY ALL""", *RESOLVED)


def missing_sites(spark, d) -> DataFrame:
    """Sites in the data that the map does not know."""
    keys = centers.map_keys(V.cmap(spark, d), {})
    return centers.missing_sites(V.snap(spark, d), keys)


MISSING_SITES = V.with_sql("""
SELECT DISTINCT site FROM v_snap WHERE site NOT IN (SELECT site FROM v_map)""", V.SNAP, V.CMAP)


# --- shares and allocation ---------------------------------------------------

def _settle_lines(spark, d, label=True) -> DataFrame:
    l = V.line(spark, d)
    n = F.col("l_linenumber")
    # Shares by line number: two entities, part of one, too much, a project and an entity, none.
    item = lambda t, a, b: F.struct(F.lit(t).alias("label"), F.lit(a).alias("num"), F.lit(b).alias("den"))
    shares = (
        F.when(n == 1, F.array(item("RHI", 1, 3), item("RENSTROYDETAL", 2, 3)))
        .when(n == 2, F.array(item("RHI", 1, 2)))
        .when(n == 3, F.array(item("RHI", 1, 2), item("RSD", 2, 3)))
        .when(n == 4, F.array(item("1-URGENT", 1, 4), item("UST LUGA", 3, 4)))
        .when(n == 5, F.array(item("ODA", 2, 3)))
    )
    return dedup.prepare(l.withColumns({
        "person_raw": F.lit(None).cast("string"), "cost_center": F.when(n != 7, F.col("o_orderpriority")),
        "cost_center_name": F.col("o_orderpriority"), "in_map": F.lit(True), "company": F.lit("BSK"),
        "company2": F.lit(None).cast("string"), "site_label": F.lit(None).cast("string"),
        "decision": F.when(n == 6, "UNMATCHED").otherwise("AUTO"), "shares": shares.cast(_SHARES)}))


def share_allocate(spark, d) -> DataFrame:
    """Shares exploded and summed to allocation rows."""
    keys = centers.map_keys(V.cmap(spark, d), {})
    rows = A.allocate(A.explode_shares(_settle_lines(spark, d), keys), details=False, centers=False)
    return rows.select("feed", "category", "cost_center", "company", "currency", "share_note", "amount",
                       "n_lines", "n_persons", "n_auto", "n_unmatched", "first_date", "last_date")


_PARTS = """
v_base AS (
  SELECT *, CASE WHEN l_linenumber IN (6, 7) THEN '(UNALLOCATED)' ELSE o_orderpriority END AS cc,
         CASE WHEN l_linenumber = 6 THEN 'UNMATCHED' ELSE 'AUTO' END AS decision
  FROM v_line),
v_spec(ln, project, co, note, num, den) AS (VALUES
  (1, NULL, 'RHI', 'RHI 1/3', 1, 3), (1, NULL, 'RSS', 'RENSTROYDETAL 2/3', 2, 3),
  (2, NULL, 'RHI', 'RHI 1/2', 1, 2), (2, NULL, 'BSK', '(rest 0.50)', 1, 2),
  (3, NULL, 'BSK', 'SHARE ERROR: RHI 1/2, RSD 2/3', 1, 1),
  (4, '1-URGENT', NULL, '1-URGENT 1/4', 1, 4), (4, NULL, 'UST LUGA', 'UST LUGA 3/4', 3, 4),
  (5, NULL, 'BSK', '', 1, 1), (6, NULL, '', '', 1, 1), (7, NULL, '', '', 1, 1)),
v_parts AS (
  SELECT b.*, coalesce(m.code, cc) AS cost_center, coalesce(m.company, co) AS company, note AS share_note,
         CAST(amount * num / den AS DECIMAL(28,10)) AS part
  FROM v_base b JOIN v_spec ON ln = l_linenumber LEFT JOIN v_map m ON m.site = project)"""
SHARE_ALLOCATE = V.with_sql("""
SELECT feed, category, cost_center, company, currency, share_note,
       CAST(round(sum(part), 2) AS DECIMAL(18,2)) AS amount, count(*) AS n_lines,
       count(DISTINCT staff_id) AS n_persons, count(*) FILTER (decision = 'AUTO') AS n_auto,
       count(*) FILTER (decision = 'UNMATCHED') AS n_unmatched, min(doc_date) AS first_date, max(doc_date) AS last_date
FROM v_parts GROUP BY 1, 2, 3, 4, 5, 6""", V.LINE, V.CMAP, _PARTS)


def _thirds(spark, d) -> DataFrame:
    """Every line in three equal parts: each allocation row is rounded on its own."""
    l = dedup.prepare(_settle_lines(spark, d).drop("shares").withColumn("shares", F.array(*[
        F.struct(F.lit(x).alias("label"), F.lit(1).alias("num"), F.lit(3).alias("den"))
        for x in ("RHI", "RSS", "BSK")]).cast(_SHARES)).withColumn("cost_center", F.col("o_orderpriority"))
        .withColumn("decision", F.lit("AUTO")))
    return l


def remainder_settle(spark, d) -> DataFrame:
    """A10: rounding rests go to the largest row of a feed and currency."""
    keys = centers.map_keys(V.cmap(spark, d), {})
    l = _thirds(spark, d)
    rows = A.allocate(A.explode_shares(l, keys), details=False, centers=False).select(*A.KEY, "amount")
    out = A.settle_remainder(rows, reconcile.targets(l))
    return out.groupBy("feed", "currency", "company").agg(
        F.sum("amount").cast(CENTS).alias("amount"), F.count(F.lit(1)).alias("n_rows"))


REMAINDER_SETTLE = V.with_ctes("""
v_rows AS (
  SELECT feed, category, o_orderpriority AS cost_center, co AS company, currency, co || ' 1/3' AS share_note,
         CAST(round(sum(CAST(amount * 1 / 3 AS DECIMAL(28,10))), 2) AS DECIMAL(18,2)) AS amount
  FROM v_line CROSS JOIN (VALUES ('RHI'), ('RSS'), ('BSK')) t(co) GROUP BY ALL),
v_gap AS (
  SELECT r.feed, r.currency, t.target - r.have AS gap
  FROM (SELECT feed, currency, sum(amount) AS have FROM v_rows GROUP BY 1, 2) r
  JOIN (SELECT feed, currency, CAST(round(sum(amount), 2) AS DECIMAL(18,2)) AS target FROM v_line GROUP BY 1, 2) t
  USING (feed, currency)),
v_big AS (
  SELECT *, row_number() OVER (PARTITION BY feed, currency ORDER BY abs(amount) DESC, category DESC, cost_center DESC,
                               company DESC, share_note DESC) AS rn FROM v_rows)
SELECT feed, currency, company,
       CAST(sum(amount + CASE WHEN rn = 1 AND abs(gap) BETWEEN 0.005 AND 0.5 THEN gap ELSE 0 END) AS DECIMAL(18,2)) AS amount,
       count(*) AS n_rows
FROM v_big JOIN v_gap USING (feed, currency) GROUP BY 1, 2, 3""", V.LINE)


def pool_split(spark, d) -> DataFrame:
    """The order total, split to the cent over the order's lines."""
    o = V.load(spark, d, "orders")
    pools = A.pool_totals(o.select(F.col("o_orderkey").cast("string").alias("company"),
                                   F.col("o_totalprice").cast("decimal(18,6)").alias("amount")))
    l = V.line(spark, d).select("source_seq", "row_no", F.col("l_orderkey").cast("string").alias("company"))
    out = A.split_pool(A.bridge_pools(l, pools), pools)
    return out.select("pool_company", "row_no", "amount")


POOL_SPLIT = V.with_sql("""
SELECT CAST(l_orderkey AS VARCHAR) AS pool_company, row_no,
       CAST((cents // n + CASE WHEN pos <= cents % n THEN 1 ELSE 0 END) / 100 AS DECIMAL(18,2)) AS amount
FROM (SELECT l_orderkey, row_no, count(*) OVER (PARTITION BY l_orderkey) AS n,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY row_no) AS pos FROM v_line)
JOIN (SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,6)) * 100) AS BIGINT) AS cents FROM orders)
  ON l_orderkey = o_orderkey""", V.LINE)


def pool_bridge(spark, d) -> DataFrame:
    """Pools of companies in several spellings; persons without a pool take the one without persons."""
    o = V.load(spark, d, "orders")
    pool = F.when(F.col("o_orderpriority") == "1-URGENT", "Spare / Pool").when(
        F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "RC Moskova").otherwise("rc")).when(
        F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "RENSERVIS").otherwise("RSS")).otherwise(" rsd ")
    pools = A.pool_totals(o.select(pool.alias("company"), F.col("o_totalprice").cast("decimal(18,6)").alias("amount")))
    spelled = F.array(*map(F.lit, ("rhi", "RHI", "RC-Peter", "Renstroydetal", "rs", "Unknown Co", " - ")))
    l = V.line(spark, d).select("source_seq", "row_no", F.get(
        spelled, F.col("l_linenumber").cast("int") - 1).alias("company"))
    return A.split_pool(A.bridge_pools(l, pools), pools).select("company", "pool_company", "row_no", "amount")


POOL_BRIDGE = V.with_ctes("""
p AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'SPARE POOL' WHEN o_orderstatus = 'F' THEN 'RC'
                  WHEN o_orderstatus = 'O' THEN 'RSS' ELSE 'RSD' END AS pool_company,
             CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,6))) * 100) AS BIGINT) AS cents FROM orders GROUP BY 1),
m AS (SELECT row_no, ['rhi', 'RHI', 'RC-Peter', 'Renstroydetal', 'rs', 'Unknown Co'][l_linenumber] AS company,
             CASE l_linenumber WHEN 3 THEN 'RC' WHEN 4 THEN 'RSD' WHEN 5 THEN 'RSS' ELSE 'SPARE POOL' END AS pool_company
      FROM v_line WHERE l_linenumber < 7),
r AS (SELECT *, count(*) OVER (PARTITION BY pool_company) AS n,
             row_number() OVER (PARTITION BY pool_company ORDER BY row_no) AS pos FROM m)
SELECT company, pool_company, row_no,
       CAST((cents // n + CASE WHEN pos <= cents % n THEN 1 ELSE 0 END) / 100 AS DECIMAL(18,2)) AS amount
FROM r JOIN p USING (pool_company)""", V.LINE)


# --- reconciliation ----------------------------------------------------------

def _closed(spark, d) -> DataFrame:
    """Orders declare their total; their lines are what is read and allocated."""
    o = V.load(spark, d, "orders").select(F.col("o_orderkey").alias("_k"), F.col("o_totalprice"))
    l = _settle_lines(spark, d).join(o, F.col("l_orderkey") == F.col("_k")).drop("_k")
    l = l.withColumns({
        "feed": F.col("l_orderkey").cast("string"),
        "declared": F.create_map(F.lit("total"), F.col("o_totalprice").cast("decimal(18,6)")),
        "doc_date": F.when(F.col("l_linenumber") != 5, F.col("doc_date")),
        "amount": F.when(F.col("l_suppkey") % 11 != 0, F.col("amount")),
        "shares": F.lit(None).cast(_SHARES)})
    amountless = l.filter("amount is null")
    paid = l.filter("amount is not null")
    keys = centers.map_keys(V.cmap(spark, d), {})
    rows = A.allocate(A.explode_shares(paid, keys), details=False, centers=False).select(*A.KEY, "amount")
    rows = A.settle_remainder(rows, reconcile.targets(paid))
    return reconcile.close(reconcile.control(paid, rows, amountless=amountless))


def control_close(spark, d) -> DataFrame:
    """One control row per order and currency."""
    return _closed(spark, d).select(
        "feed", "currency", "read", "allocated", "unallocated", "n_lines", "n_undated", "n_amountless",
        "declared", "declared_gap", "difference", "net", "closed")


_CONTROL = """
v_src AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS ord, l_linenumber, currency, row_no,
         CASE WHEN l_suppkey % 11 <> 0 THEN amount END AS amount, l_linenumber = 5 AS undated FROM v_line),
v_ctl AS (
  SELECT ord AS feed, currency, coalesce(CAST(round(sum(amount), 2) AS DECIMAL(18,2)), 0) AS read,
         coalesce(CAST(round(sum(amount) FILTER (l_linenumber NOT IN (6, 7)), 2) AS DECIMAL(18,2)), 0) AS allocated,
         coalesce(CAST(round(sum(amount) FILTER (l_linenumber IN (6, 7)), 2) AS DECIMAL(18,2)), 0) AS unallocated,
         count(amount) AS n_lines, count(*) FILTER (undated AND amount IS NOT NULL) AS n_undated,
         count(*) FILTER (amount IS NULL) AS n_amountless
  FROM v_src GROUP BY 1, 2),
v_decl AS (SELECT CAST(o_orderkey AS VARCHAR) AS feed, CAST(o_totalprice AS DECIMAL(18,2)) AS declared FROM orders),
v_closed AS (
  SELECT *, CAST(declared - read AS DECIMAL(18,2)) AS declared_gap, CAST(0 AS DECIMAL(18,2)) AS difference,
         CAST(allocated + unallocated AS DECIMAL(18,2)) AS net,
         n_amountless = 0 AND abs(declared - read) <= least(0.5, 0.01 * greatest(1, n_lines)) AS closed
  FROM v_ctl JOIN v_decl USING (feed))"""
CONTROL_CLOSE = V.with_sql("""
SELECT feed, currency, CAST(read AS DECIMAL(18,2)) AS read, CAST(allocated AS DECIMAL(18,2)) AS allocated,
       CAST(unallocated AS DECIMAL(18,2)) AS unallocated, n_lines, n_undated, n_amountless, declared, declared_gap,
       difference, net, closed FROM v_closed""", V.LINE, _CONTROL)


def control_totals(spark, d) -> DataFrame:
    """Totals per currency with the number of open control rows."""
    c = _closed(spark, d)
    o = reconcile.open_controls(c).groupBy("currency").agg(F.count(F.lit(1)).alias("n_open"))
    return reconcile.totals(c).join(o, "currency", "left").select(
        "currency", "read", "duplicate", "allocated", "unallocated", "net", "rate",
        F.coalesce("n_open", F.lit(0)).alias("n_open"))


CONTROL_TOTALS = V.with_sql("""
SELECT currency, CAST(sum(read) AS DECIMAL(18,2)) AS read, CAST(0 AS DECIMAL(18,2)) AS duplicate,
       CAST(sum(allocated) AS DECIMAL(18,2)) AS allocated, CAST(sum(unallocated) AS DECIMAL(18,2)) AS unallocated,
       CAST(sum(net) AS DECIMAL(18,2)) AS net,
       CAST(round(CAST(sum(allocated) AS DOUBLE) / CAST(sum(net) AS DOUBLE) * 100, 2) AS DECIMAL(10,2)) AS rate,
       count(*) FILTER (NOT closed) AS n_open FROM v_closed GROUP BY 1""", V.LINE, _CONTROL)


def detail_check(spark, d) -> DataFrame:
    """C4: persons per invoice, raw feed against its copy; the order date is the invoice."""
    c = dedup.prepare(V.copies(spark, d)).withColumn(
        "invoice_no", F.date_format("doc_date", "yyyy-MM-dd")).withColumn("person", F.col("person_raw"))
    return reconcile.detail_check(c.filter("feed = 'raw.xls'"), c.filter("feed = 'copy.xlsx' and invoice_no is not null"))


DETAIL_CHECK = V.with_ctes("""
v_d AS (SELECT CAST(doc_date AS VARCHAR) AS invoice_no, sig, arg_max(person, o_orderkey) AS p FROM v_raw GROUP BY 1, 2),
v_c AS (SELECT CAST(doc_date AS VARCHAR) AS invoice_no, sig, arg_max(person, o_orderkey) AS p FROM v_copy
        WHERE doc_date IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(v_d.invoice_no, v_c.invoice_no) AS invoice_no, 'raw.xls' AS feed, count(v_d.p) AS n_detail,
       count(v_c.p) AS n_charged,
       coalesce(string_agg(v_d.p, ', ' ORDER BY v_d.p) FILTER (v_c.p IS NULL), '') AS missing,
       coalesce(string_agg(v_c.p, ', ' ORDER BY v_c.p) FILTER (v_d.p IS NULL), '') AS surplus,
       count(*) FILTER (v_c.p IS NULL OR v_d.p IS NULL) = 0 AS consistent
FROM v_d FULL JOIN v_c ON v_d.invoice_no = v_c.invoice_no AND v_d.sig = v_c.sig
GROUP BY 1""", V.COPIES)


# --- duplicates --------------------------------------------------------------

def dedup_exact(spark, d) -> DataFrame:
    """Removed lines of the copy, their kept line and sign conflicts."""
    p = dedup.prepare(V.copies(spark, d))
    pairs = cut_lineage(dedup.pair_lines(p))
    both = dedup.paired(p, pairs)
    return both.select(
        "tier", "o_row", "k_row", F.col("o_feed").alias("removed_feed"), F.col("k_feed").alias("kept_feed"),
        cents("o_amount").alias("removed_amount"), cents("k_amount").alias("kept_amount"),
        ((F.col("k_amount") >= 0) != (F.col("o_amount") >= 0)).alias("sign_conflict"))


DEDUP_EXACT = V.with_ctes("""
v_k AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_raw),
v_o AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_copy
        WHERE doc_date IS NOT NULL)
SELECT 3 AS tier, o.o_orderkey AS o_row, k.o_orderkey AS k_row, 'copy.xlsx' AS removed_feed, 'raw.xls' AS kept_feed,
       o.amount AS removed_amount, k.amount AS kept_amount, (k.amount >= 0) <> (o.amount >= 0) AS sign_conflict
FROM v_o o JOIN v_k k ON o.doc_date = k.doc_date AND abs(o.amount) = abs(k.amount) AND o.ccy = k.ccy AND o.sig = k.sig
  AND o.rn = k.rn""", V.COPIES)


def dedup_suspects(spark, d) -> DataFrame:
    """Lines that stay but look like a changed or undated copy."""
    p = dedup.prepare(V.copies(spark, d))
    kept, pairs = dedup.eliminate(p)
    return dedup.suspicions(p, cut_lineage(kept), pairs).groupBy("feed", "reason", "ccy").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("amount").cast(CENTS).alias("amount"),
        F.sum("other_amount").cast(CENTS).alias("other_amount"))


DEDUP_SUSPECTS = V.with_ctes("""
v_k AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_raw),
v_o AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_copy
        WHERE doc_date IS NOT NULL),
v_gone AS (SELECT o.o_orderkey FROM v_o o JOIN v_k k ON o.doc_date = k.doc_date AND abs(o.amount) = abs(k.amount)
           AND o.ccy = k.ccy AND o.sig = k.sig AND o.rn = k.rn),
v_kept AS (
  SELECT 'raw.xls' AS feed, * FROM v_raw
  UNION ALL SELECT 'copy.xlsx', * FROM v_copy WHERE o_orderkey NOT IN (SELECT o_orderkey FROM v_gone)),
v_hit AS (
  SELECT c.feed, c.ccy, c.amount, arg_min(r.amount, r.o_orderkey) AS other
  FROM v_kept c JOIN v_kept r ON c.sig = r.sig AND c.doc_date IS NOT DISTINCT FROM r.doc_date
    AND r.feed <> c.feed AND abs(r.amount) <> abs(c.amount)
  WHERE c.feed = 'copy.xlsx' GROUP BY c.feed, c.ccy, c.amount, c.o_orderkey)
SELECT feed, 'amount_changed' AS reason, ccy, count(*) AS n_lines, CAST(sum(amount) AS DECIMAL(18,2)) AS amount,
       CAST(sum(other) AS DECIMAL(18,2)) AS other_amount
FROM v_hit GROUP BY 1, 3""", V.COPIES)


def dedup_overlap(spark, d) -> DataFrame:
    """Control rows of both feeds, with the feeds that overlap in part."""
    from ..operators.reconcile import control
    p = dedup.prepare(V.copies(spark, d))
    kept, pairs = dedup.eliminate(p)
    rows = A.allocate(A.explode_shares(kept, centers.map_keys(V.cmap(spark, d), {})), details=False, centers=False)
    return dedup.overlap_warnings(control(p, rows, pairs))


DEDUP_OVERLAP = V.with_ctes("""
v_k AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_raw),
v_o AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_copy
        WHERE doc_date IS NOT NULL),
v_gone AS (SELECT o.o_orderkey FROM v_o o JOIN v_k k ON o.doc_date = k.doc_date AND abs(o.amount) = abs(k.amount)
           AND o.ccy = k.ccy AND o.sig = k.sig AND o.rn = k.rn)
SELECT 'copy.xlsx' AS feed, ccy AS currency, count(*) AS n_lines, count(g.o_orderkey) AS n_duplicate,
       count(*) - count(g.o_orderkey) AS n_alone
FROM v_copy c LEFT JOIN v_gone g ON c.o_orderkey = g.o_orderkey GROUP BY 2
HAVING count(g.o_orderkey) * 2 >= count(*) AND count(g.o_orderkey) < count(*)""", V.COPIES)
