"""Queries over rollups, reports and quality measures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import category_of, route
from ..functions.values import CENTS, cents
from ..operators import allocate as A
from ..operators import centers, dedup, measure, reconcile, rollup
from ..operators.common import cut_lineage
from ..sources import sinks
from . import settlement as S
from . import views as V


def _parts_rows(spark, d):
    keys = centers.map_keys(V.cmap(spark, d), {})
    parts = cut_lineage(A.explode_shares(S._settle_lines(spark, d), keys))
    return parts, cut_lineage(A.allocate(parts))


_ROWS = """
v_rows AS (
  SELECT feed, category, cost_center, company, currency, share_note,
         CAST(round(sum(part), 2) AS DECIMAL(18,2)) AS amount, count(*) AS n_lines, count(DISTINCT staff_id) AS n_persons,
         count(*) FILTER (decision = 'AUTO') AS n_auto, count(*) FILTER (decision = 'UNMATCHED') AS n_unmatched,
         min(doc_date) AS first_date, max(doc_date) AS last_date
  FROM v_parts GROUP BY 1, 2, 3, 4, 5, 6)"""
ROWS = (V.LINE, V.CMAP, S._PARTS, _ROWS)


def center_rollup(spark, d) -> DataFrame:
    """Centres over all feeds."""
    parts, rows = _parts_rows(spark, d)
    return rollup.by_center(rows, parts).select(
        "cost_center", "currency", "amount", "n_lines", "n_auto", "n_unmatched", "companies", "n_persons", "share_pct")


_CENTER = """
SELECT r.cost_center, r.currency, r.amount, n_lines, n_auto, n_unmatched, companies, n_persons,
       CAST(round(CAST(abs(r.amount) AS DOUBLE) / CAST(sum(abs(r.amount)) OVER (PARTITION BY r.currency) AS DOUBLE) * 100, 2) AS DECIMAL(12,2)) AS share_pct
FROM (SELECT cost_center, currency, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, CAST(sum(n_lines) AS BIGINT) AS n_lines,
             CAST(sum(n_auto) AS BIGINT) AS n_auto, CAST(sum(n_unmatched) AS BIGINT) AS n_unmatched,
             coalesce(string_agg(DISTINCT nullif(company, ''), '; ' ORDER BY nullif(company, '')), '') AS companies
      FROM v_rows GROUP BY 1, 2) r
JOIN (SELECT cost_center, currency, count(DISTINCT staff_id) AS n_persons FROM v_parts GROUP BY 1, 2) p
  ON r.cost_center = p.cost_center AND r.currency = p.currency"""
CENTER_ROLLUP = V.with_sql(_CENTER, *ROWS)


def top_centers(spark, d) -> DataFrame:
    """The five largest centres."""
    return rollup.top_centers(center_rollup(spark, d), 5).select("cost_center", "currency", "amount")


TOP_CENTERS = V.with_sql(f"""
SELECT cost_center, currency, amount FROM ({_CENTER}) ORDER BY amount DESC, cost_center, currency LIMIT 5""", *ROWS)


def company_rollup(spark, d) -> DataFrame:
    """Companies and the projects below each, with shares."""
    parts, rows = _parts_rows(spark, d)
    return rollup.by_company(rows, parts)


COMPANY_ROLLUP = V.with_sql("""
SELECT s.firm AS company, s.currency, s.cost_center, CASE WHEN s.g = 1 THEN 'company' ELSE 'project' END AS level, s.amount, s.n_lines,
       p.n_persons, CAST(round(CAST(s.amount AS DOUBLE) / CAST(CASE WHEN s.g = 1 THEN cur ELSE f.amount END AS DOUBLE) * 100, 2) AS DECIMAL(12,2)) AS share_pct
FROM v_sums s
JOIN (SELECT firm, currency, coalesce(cost_center, '') AS cost_center, grouping(cost_center) AS g, count(DISTINCT staff_id) AS n_persons
      FROM (SELECT *, coalesce(nullif(company, ''), CASE WHEN cost_center = '(UNALLOCATED)' THEN '(unallocated)' ELSE '(no company)' END) AS firm FROM v_parts)
      GROUP BY GROUPING SETS ((firm, currency), (firm, currency, cost_center))) p
  ON s.firm = p.firm AND s.currency = p.currency AND s.cost_center = p.cost_center AND s.g = p.g
JOIN (SELECT currency, sum(amount) AS cur FROM v_sums WHERE g = 1 GROUP BY 1) c ON c.currency = s.currency
JOIN v_sums f ON f.g = 1 AND f.firm = s.firm AND f.currency = s.currency""", *ROWS, """
v_sums AS (SELECT firm, currency, coalesce(cost_center, '') AS cost_center, grouping(cost_center) AS g,
                  CAST(sum(amount) AS DECIMAL(18,2)) AS amount, CAST(sum(n_lines) AS BIGINT) AS n_lines
           FROM (SELECT *, coalesce(nullif(company, ''), CASE WHEN cost_center = '(UNALLOCATED)' THEN '(unallocated)' ELSE '(no company)' END) AS firm FROM v_rows)
           GROUP BY GROUPING SETS ((firm, currency), (firm, currency, cost_center)))""")


def allocation_totals(spark, d) -> DataFrame:
    """Allocation rows with totals per feed and currency."""
    return rollup.with_totals(_parts_rows(spark, d)[1])


ALLOCATION_TOTALS = V.with_sql("""
SELECT currency, feed, cost_center, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, CAST(sum(n_lines) AS BIGINT) AS n_lines,
       grouping(currency, feed, cost_center) AS level
FROM v_rows GROUP BY GROUPING SETS ((currency, feed, cost_center), (currency, feed), (currency))""", *ROWS)


def allocation_table(spark, d) -> DataFrame:
    """The allocation table as delivered."""
    t = sinks.allocation_table(_parts_rows(spark, d)[1])
    return t.select("feed", "company", "cost_center", "category", "share_note", "amount", "currency", "feed_share",
                    "period", "status")


ALLOCATION_TABLE = V.with_sql("""
SELECT feed, coalesce(nullif(company, ''), '(no company)') AS company, cost_center, category, share_note, amount, currency,
       CAST(round(CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY feed, currency) AS DOUBLE), 4) AS DECIMAL(12,4)) AS feed_share,
       CASE WHEN strftime(first_date, '%m.%Y') = strftime(last_date, '%m.%Y') THEN strftime(first_date, '%m.%Y')
            ELSE strftime(first_date, '%m.%Y') || ' - ' || strftime(last_date, '%m.%Y') END AS period,
       concat_ws(' | ', CASE WHEN cost_center = '(UNALLOCATED)' THEN 'NO CENTRE' END,
                 CASE WHEN n_unmatched > 0 THEN n_unmatched || ' unmatched' END) AS status
FROM v_rows""", *ROWS)


def line_table(spark, d) -> DataFrame:
    """Resolved lines as delivered, 28 columns (the comparable ones)."""
    l = S.resolved(spark, d).withColumns({
        "candidate_count": F.lit(1), "description": F.lit(""), "person_raw": F.lit(None).cast("string")})
    return sinks.line_table(l).select("source", "row_no", "doc_date", "staff_id", "confidence", "period", "relation",
                                      "site", "cost_center", "company", "amount", "currency", "decision")


LINE_TABLE = V.with_sql("""
SELECT feed AS source, row_no, doc_date, sid AS staff_id, CAST(confidence AS DOUBLE) AS confidence,
       CASE WHEN sid IS NOT NULL THEN period END AS period, rel AS relation, CASE WHEN sid IS NOT NULL THEN site END AS site,
       CASE WHEN weak THEN '(UNALLOCATED)' ELSE cost_center END AS cost_center,
       CASE WHEN weak THEN '' ELSE coalesce(company, CASE WHEN sid IS NOT NULL THEN company2 END) END AS company, amount, currency, decision
FROM (SELECT *, decision = 'UNMATCHED' AND (cost_center IS NOT NULL OR company IS NOT NULL) AS weak FROM v_dec)""", *S.RESOLVED)


# --- over resolved lines -----------------------------------------------------

def _resolved(spark, d) -> DataFrame:
    return S.resolved(spark, d).withColumn("person_raw", F.concat(F.lit("Person "), "staff_id"))


def run_summary(spark, d) -> DataFrame:
    """Counts and amounts of a run by decision, method, category, source, centre and currency."""
    return rollup.run_summary(_resolved(spark, d))


RUN_SUMMARY = V.with_sql("""
SELECT metric, key, count(*) AS n_lines, CAST(round(sum(amount), 2) AS DECIMAL(18,2)) AS amount FROM (
  SELECT unnest(['decision', 'method', 'category', 'source_type', 'cost_center', 'currency', 'unmatched_person']) AS metric,
         unnest([decision, 'staff_id', category, 'travel_ledger', coalesce(cost_center, '(none)') || ' ' || currency, currency,
                 CASE WHEN decision = 'UNMATCHED' AND sid IS NOT NULL THEN 'Person ' || sid END]) AS key, amount FROM v_dec)
WHERE key IS NOT NULL GROUP BY 1, 2""", *S.RESOLVED)


def label_summary(spark, d) -> DataFrame:
    """U4: the feeds' labels against the resolved projects."""
    return rollup.label_summary(_resolved(spark, d))


LABEL_SUMMARY = V.with_sql("""
SELECT CASE WHEN label_class IN ('agrees', 'unknown') THEN 'agrees' ELSE label_class END AS label_class, count(*) AS n_lines
FROM v_dec GROUP BY 1""", *S.RESOLVED)


def cover_counts(spark, d) -> DataFrame:
    """Line counts of the cover with the main month of the run."""
    r = _resolved(spark, d)
    return rollup.cover_counts(r).join(rollup.main_month(r).select("month"), F.lit(True))


COVER_COUNTS = V.with_sql("""
SELECT count(*) AS n_expense, 0 AS n_register, count(*) FILTER (decision = 'AUTO') AS n_auto,
       count(*) FILTER (decision = 'REVIEW') AS n_review, count(*) FILTER (decision = 'UNMATCHED') AS n_unmatched,
       0 AS n_register_waiting,
       (SELECT m FROM (SELECT CAST(date_trunc('month', doc_date) AS DATE) AS m, count(*) AS n FROM v_line GROUP BY 1) ORDER BY n DESC, m LIMIT 1) AS month
FROM v_dec""", *S.RESOLVED)


def center_table(spark, d) -> DataFrame:
    """Plain centre by currency table."""
    return rollup.center_table(_resolved(spark, d))


CENTER_TABLE = V.with_sql("""
SELECT coalesce(cost_center, '(none)') AS cost_center, currency, count(*) AS n_lines, CAST(round(sum(amount), 2) AS DECIMAL(18,2)) AS amount
FROM v_dec GROUP BY 1, 2""", *S.RESOLVED)


def review_queue(spark, d) -> DataFrame:
    """Lines that wait for a person."""
    return rollup.review_queue(_resolved(spark, d)).select("row_no", "decision")


REVIEW_QUEUE = V.with_sql("SELECT row_no, decision FROM v_dec WHERE decision <> 'AUTO'", *S.RESOLVED)


def suggest_map(spark, d) -> DataFrame:
    """U8: map rows proposed for unmapped sites."""
    r = _resolved(spark, d)
    keys = centers.map_keys(V.cmap(spark, d), {})
    staff = V.snap(spark, d).select("site", "company", "company2", "load_seq")
    return rollup.suggest_map(r, keys, staff).select("site", "code", "n_staff", "n_lines", "amount")


SUGGEST_MAP = V.with_sql("""
SELECT site, '5-LOW' AS code, (SELECT count(*) FROM v_snap s WHERE s.site = u.site) AS n_staff, count(*) AS n_lines,
       CAST(round(sum(amount), 2) AS DECIMAL(18,2)) AS amount
FROM v_dec u WHERE sid IS NOT NULL AND NOT hit GROUP BY site""", *S.RESOLVED)


def coverage(spark, d) -> DataFrame:
    """M1: coverage per feed with a total."""
    return measure.coverage(_feeds(spark, d))


def _feeds(spark, d) -> DataFrame:
    # One feed arrives as an attachment, the others on their own.
    r = _resolved(spark, d)
    return r.withColumn("source_file", F.when(F.col("source_file").endswith("P"), F.col("source_file")).otherwise(
        F.element_at(F.split("source_file", "> "), -1)))


_COVER = """
v_cov0 AS (SELECT feed, feed = 'feed P' AS attachment, count(*) AS n_lines, count(sid) AS n_person, count(sid) AS n_id,
                  count(*) FILTER (decision = 'AUTO') AS n_auto, count(*) FILTER (decision = 'REVIEW') AS n_review,
                  count(*) FILTER (decision = 'UNMATCHED') AS n_unmatched FROM v_dec GROUP BY 1),
v_cov1 AS (SELECT * FROM v_cov0 UNION ALL
           SELECT '(total)', false, CAST(sum(n_lines) AS BIGINT), CAST(sum(n_person) AS BIGINT), CAST(sum(n_id) AS BIGINT),
                  CAST(sum(n_auto) AS BIGINT), CAST(sum(n_review) AS BIGINT), CAST(sum(n_unmatched) AS BIGINT) FROM v_cov0 WHERE NOT attachment),
v_cov AS (SELECT *, CAST(round(CAST(n_auto AS DOUBLE) / n_lines * 100, 1) AS DECIMAL(6,1)) AS auto_rate,
                 CAST(round(CAST(n_person AS DOUBLE) / n_lines * 100, 1) AS DECIMAL(6,1)) AS person_rate,
                 CAST(round(CAST(n_auto + n_review AS DOUBLE) / n_lines * 100, 1) AS DECIMAL(6,1)) AS resolved_rate FROM v_cov1)"""
COVERAGE = V.with_sql("SELECT * FROM v_cov", *S.RESOLVED, _COVER)


def compare_runs(spark, d) -> DataFrame:
    """M6: the run against one with a lower bar for AUTO."""
    before = cut_lineage(_feeds(spark, d))
    after = before.withColumn("decision", F.when(F.col("decision") == "REVIEW", "AUTO").otherwise(F.col("decision")))
    return measure.compare_runs(measure.coverage(before), measure.coverage(after))


COMPARE_RUNS = V.with_sql("""
SELECT feed, n_auto AS before_n_auto, n_review AS before_n_review, n_unmatched AS before_n_unmatched, auto_rate AS before_auto_rate,
       n_auto + n_review AS after_n_auto, 0 AS after_n_review, n_unmatched AS after_n_unmatched, resolved_rate AS after_auto_rate,
       CAST(resolved_rate - auto_rate AS DECIMAL(8,1)) AS auto_rate_change
FROM v_cov WHERE NOT attachment""", *S.RESOLVED, _COVER)


# --- raw feed against its copy -------------------------------------------------

def align(spark, d) -> DataFrame:
    """M3: raw lines beside the manual copy's lines."""
    p = dedup.prepare(V.copies(spark, d))
    pairs = cut_lineage(dedup.pair_lines(p))
    return measure.align(p, pairs, "raw.xls", "copy.xlsx").select("k_row", "o_row", "how")


ALIGN = V.with_ctes("""
v_k AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_raw),
v_o AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_copy)
SELECT k.o_orderkey AS k_row, o.o_orderkey AS o_row,
       CASE WHEN k.o_orderkey IS NULL OR o.o_orderkey IS NULL THEN 'unaligned' ELSE 'bucket' END AS how
FROM v_k k FULL JOIN v_o o ON o.doc_date = k.doc_date AND abs(o.amount) = abs(k.amount) AND o.ccy = k.ccy AND o.sig = k.sig
  AND o.rn = k.rn""", V.COPIES)


def accuracy(spark, d) -> DataFrame:
    """M4: outcomes in all three readings."""
    o = V.load(spark, d, "orders")
    k = F.pmod("o_orderkey", F.lit(8))
    a = o.select(
        F.when(k == 0, "unaligned").otherwise("bucket").alias("how"),
        F.when(k == 1, F.array().cast("array<string>")).when(k.isin(2, 3), F.array(F.lit("RHI")))
         .when(k == 4, F.array(F.lit("SAREN"))).when(k == 5, F.array(F.lit("AMUR"), F.lit("RHI")))
         .otherwise(F.array(F.lit("UST LUGA"))).alias("manual_labels"),
        F.when(F.col("o_orderstatus") == "F", "AGPP").when(F.col("o_orderstatus") == "O", "GPP").otherwise("OTHER").alias("cost_center"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "RHI").otherwise("UST LUGA").alias("company"),
        (F.col("o_custkey") % 2 == 0).alias("has_id"),
        F.when(F.col("o_custkey") % 5 == 0, "UNMATCHED").otherwise("AUTO").alias("decision"))
    out = None
    for r in ("project", "entity", "informative"):
        one = measure.accuracy(a, r).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_lines")).withColumn("reading", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


ACCURACY = """
WITH a AS (
  SELECT o_orderkey % 8 = 0 AS un,
    CASE WHEN o_orderkey % 8 = 1 THEN [] WHEN o_orderkey % 8 IN (2, 3) THEN ['RHI'] WHEN o_orderkey % 8 = 4 THEN ['SAREN']
         WHEN o_orderkey % 8 = 5 THEN ['AMUR', 'RHI'] ELSE ['UST LUGA'] END AS m,
    CASE o_orderstatus WHEN 'F' THEN ['AMUR', 'AMURSKY', 'AGPZ'] WHEN 'O' THEN ['UST LUGA GPP', 'UST LUGA', 'GPP']
         ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN ['RHI', 'RHI RUSSIA'] ELSE ['UST LUGA', 'UST LUGA GPP', 'USTLUGA'] END END AS e,
    o_custkey % 2 = 0 AS has_id, o_custkey % 5 <> 0 AS got FROM orders),
r AS (SELECT a.*, reading, CASE WHEN reading = 'entity' AND has_id THEN list_append(e, 'RHI') ELSE e END AS x
      FROM a CROSS JOIN (VALUES ('project'), ('entity'), ('informative')) t(reading)
      WHERE reading <> 'informative' OR (len(m) > 0 AND m <> ['RHI']))
SELECT reading, CASE WHEN un THEN 'unaligned' WHEN len(m) = 0 THEN 'no_manual_label'
    WHEN m = ['SAREN'] THEN CASE WHEN got THEN 'group_conflict' ELSE 'out_of_scope' END
    WHEN NOT got THEN 'no_result' WHEN list_has_any(m, x) THEN 'same' ELSE 'different' END AS outcome, count(*) AS n_lines
FROM r GROUP BY 1, 2"""


def route_rule(spark, d) -> DataFrame:
    """Route class by kind of label; routes from the nations of customer and supplier."""
    l = V.load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    o = V.load(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = V.load(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = V.load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        s, F.col("l_suppkey") == F.col("s_suppkey"))
    port = lambda k: F.when(k % 4 == 0, "ESB").when(k % 4 == 1, "IST").when(k % 4 == 2, "LED").otherwise("VKO")
    text = F.concat(F.lit("TK1234567890 X "), port(F.col("c_nationkey")), F.lit("-"), port(F.col("s_nationkey")), F.lit(" BILET"))
    return measure.label_rule(j.select(
        F.when(F.col("l_linenumber") == 7, "OTEL").otherwise(text).alias("description"),
        F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") < 4, "RHI").otherwise("AMUR").alias("label")))


ROUTE_RULE = """
WITH j AS (
  SELECT l_linenumber AS n, c_nationkey % 4 AS a, s_nationkey % 4 AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_linenumber <> 1)
SELECT CASE WHEN n = 7 THEN 'no_route' WHEN a < 2 AND b >= 2 THEN CASE WHEN a = 0 THEN 'in_from_hub' ELSE 'in_other' END
            WHEN a >= 2 AND b < 2 THEN 'out' ELSE 'round' END AS route_class,
       count(*) FILTER (n >= 4) AS informative, count(*) FILTER (n < 4) AS "default"
FROM j GROUP BY 1"""


def company_mismatch(spark, d) -> DataFrame:
    """Company on the label against the company in the table."""
    keys = centers.map_keys(V.cmap(spark, d), {})
    n = F.col("l_linenumber")
    l = S._settle_lines(spark, d).withColumn(
        "site_label", F.when(n < 3, "RHI").when(n == 4, "Ust-Luga").when(n == 5, "RENSERVIS"))
    return reconcile.company_mismatch(A.explode_shares(l, keys))


COMPANY_MISMATCH = V.with_sql("""
SELECT currency, label_company, company, count(*) AS n_lines, CAST(round(sum(amount), 2) AS DECIMAL(18,2)) AS amount FROM (
  SELECT row_no, currency, amount, company, CASE l_linenumber WHEN 5 THEN 'RSS' END AS label_company
  FROM v_parts WHERE l_linenumber = 5)
GROUP BY 1, 2, 3""", V.LINE, V.CMAP, S._PARTS)


def release_gate(spark, d) -> DataFrame:
    """May the table be released, and what stands against it."""
    p = cut_lineage(dedup.prepare(V.copies(spark, d)))
    kept, pairs = dedup.eliminate(p)
    kept = cut_lineage(kept)
    keys = centers.map_keys(V.cmap(spark, d), {})
    rows = A.allocate(A.explode_shares(kept, keys), details=False).select(*A.KEY, "amount", "in_map")
    rows = cut_lineage(A.settle_remainder(rows, reconcile.targets(p, pairs)))
    sus = cut_lineage(dedup.suspicions(p, kept, pairs))
    closed = cut_lineage(reconcile.close(reconcile.control(p, rows, pairs, sus)))
    return reconcile.release_gate(closed, rows, kept, sus, dedup.sign_conflicts(dedup.paired(p, pairs))).select(
        "gate", "n_open", "n_undated", "n_suspicions", "n_conflicts", "n_unmapped")


RELEASE_GATE = V.with_ctes("""
v_k AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_raw),
v_o AS (SELECT *, row_number() OVER (PARTITION BY doc_date, abs(amount), ccy, sig ORDER BY o_orderkey) AS rn FROM v_copy
        WHERE doc_date IS NOT NULL),
v_gone AS (SELECT o.o_orderkey, o.amount <> k.amount AS flip FROM v_o o JOIN v_k k ON o.doc_date = k.doc_date
           AND abs(o.amount) = abs(k.amount) AND o.ccy = k.ccy AND o.sig = k.sig AND o.rn = k.rn),
v_kept AS (
  SELECT 'raw.xls' AS feed, * FROM v_raw
  UNION ALL SELECT 'copy.xlsx', * FROM v_copy WHERE o_orderkey NOT IN (SELECT o_orderkey FROM v_gone))
SELECT 'CLOSED ATTENTION' AS gate, 0 AS n_open, (SELECT count(*) FROM v_copy WHERE doc_date IS NULL) AS n_undated,
       (SELECT count(*) FROM v_kept c WHERE feed = 'copy.xlsx' AND EXISTS (SELECT 1 FROM v_kept r WHERE c.sig = r.sig
          AND c.doc_date IS NOT DISTINCT FROM r.doc_date AND r.feed <> c.feed AND abs(r.amount) <> abs(c.amount))) AS n_suspicions,
       (SELECT count(*) FROM v_gone WHERE flip) AS n_conflicts, 0 AS n_unmapped""", V.COPIES)
