"""Does the money close? Control rows and what hangs on them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import company_of
from ..functions.values import CENTS, cents

SUM = "decimal(28,6)"
GROUP = ["feed", "currency"]
_METRICS = ["read", "duplicate", "allocated", "unallocated", "suspect"]
_COUNTS = ["n_lines", "n_undated", "n_amountless", "n_duplicate", "n_suspect"]


def _part(df: DataFrame, **values) -> DataFrame:
    """Rows (feed, currency) with some metrics filled, the others zero."""
    money = [values.get(m, F.lit(0)).cast(SUM).alias(m) for m in _METRICS]
    counts = [values.get(c, F.lit(0)).cast("bigint").alias(c) for c in _COUNTS]
    return df.select(*GROUP, *money, *counts)


def declared_totals(lines: DataFrame) -> DataFrame:
    """The total a feed declares for itself, the first one seen."""
    d = lines.filter(F.size(F.coalesce("declared", F.create_map().cast(lines.schema["declared"].dataType))) > 0)
    total = F.aggregate(F.map_values("declared"), F.lit(0).cast(SUM), lambda a, v: (a + v).cast(SUM))
    return d.groupBy("feed", F.col("ccy").alias("currency")).agg(
        cents(F.min_by(total, F.struct("source_seq", "row_no"))).alias("declared"))


def targets(lines: DataFrame, pairs: DataFrame = None) -> DataFrame:
    """Read minus duplicate per feed and currency: what allocation rows must add up to."""
    read = lines.select("feed", F.col("ccy").alias("currency"), F.col("amount").cast(SUM).alias("a"))
    if pairs is not None:
        gone = lines.join(pairs.select(F.col("o_seq").alias("source_seq"), F.col("o_row").alias("row_no")),
                          ["source_seq", "row_no"])
        read = read.unionByName(gone.select(
            "feed", F.col("ccy").alias("currency"), (-F.col("amount")).cast(SUM).alias("a")))
    return read.groupBy(*GROUP).agg(cents(F.sum("a")).alias("target"))


def control(lines: DataFrame, rows: DataFrame, pairs: DataFrame = None, suspicions: DataFrame = None,
            amountless: DataFrame = None) -> DataFrame:
    """One row per feed and currency.

    What is read is measured on the lines before elimination, what is
    allocated on the allocation rows; neither is derived from the other. All
    contributions are stacked and summed in one shuffle."""
    src = lines.withColumn("currency", F.col("ccy"))
    stack = _part(src, read=F.col("amount"), n_lines=F.lit(1),
                  n_undated=F.when(F.col("doc_date").isNull(), 1).otherwise(0))
    if amountless is not None:
        stack = stack.unionByName(_part(amountless.withColumn("currency", F.col("ccy")), n_amountless=F.lit(1)))
    if pairs is not None:
        gone = src.join(pairs.select(F.col("o_seq").alias("source_seq"), F.col("o_row").alias("row_no")),
                        ["source_seq", "row_no"])
        stack = stack.unionByName(_part(gone, duplicate=F.col("amount"), n_duplicate=F.lit(1)))
    if suspicions is not None:
        s = suspicions.withColumn("currency", F.col("ccy"))
        stack = stack.unionByName(_part(s, suspect=F.col("amount"), n_suspect=F.lit(1)))
    lost = F.col("cost_center") == V.UNALLOCATED
    stack = stack.unionByName(_part(
        rows, allocated=F.when(~lost, F.col("amount")).otherwise(0),
        unallocated=F.when(lost, F.col("amount")).otherwise(0)))
    out = stack.groupBy(*GROUP).agg(
        *[cents(F.sum(m)).alias(m) for m in _METRICS], *[F.sum(c).alias(c) for c in _COUNTS])
    both = lines if amountless is None else lines.unionByName(amountless, allowMissingColumns=True)
    if "declared" in lines.columns:
        return out.join(declared_totals(both), GROUP, "left")
    return out.withColumn("declared", F.lit(None).cast(CENTS))


def close(ctl: DataFrame) -> DataFrame:
    """Difference, net, rate, closed flag and the reasons when open."""
    diff = (F.col("read") - F.col("allocated") - F.col("unallocated") - F.col("duplicate")).cast(CENTS)
    net = (F.col("allocated") + F.col("unallocated")).cast(CENTS)
    off = (F.col("declared") - F.col("read")).cast(CENTS)
    tolerance = F.least(F.lit(0.50), 0.01 * F.greatest(F.lit(1), F.col("n_lines")))
    fits = F.coalesce(F.abs(off) <= tolerance + 1e-9, F.lit(True))
    df = ctl.withColumns({"difference": diff, "net": net, "declared_gap": off, "_fits": fits})
    reasons = F.concat_ws(
        "; ",
        F.when(F.abs("difference") >= 0.01, F.concat(F.lit("difference "), F.col("difference"))),
        F.when(F.col("n_amountless") > 0, F.concat(F.col("n_amountless"), F.lit(" lines without amount"))),
        F.when(F.col("currency") == "?", F.lit("currency unknown")),
        F.when(~F.col("_fits"), F.concat(F.lit("declared total differs by "), F.col("declared_gap"))))
    notes = F.concat_ws(
        "; ",
        F.when(F.col("n_suspect") > 0, F.concat(
            F.lit("suspected duplicates: "), F.col("n_suspect"), F.lit(" lines, "), F.col("suspect"))),
        F.when(F.col("n_undated") > 0, F.concat(F.col("n_undated"), F.lit(" undated lines"))))
    closed = ((F.abs("difference") < 0.01) & (F.col("n_amountless") == 0) & (F.col("currency") != "?")
              & F.col("_fits"))
    rate = F.when(F.col("net") == 0, 0).otherwise(F.round(F.col("allocated") / F.col("net") * 100, 2))
    return df.withColumns({"rate": rate.cast("decimal(10,2)"), "closed": closed,
                           "open_reason": reasons, "note": notes}).drop("_fits")


def control_status() -> Column:
    """CLOSED, CLOSED ATTENTION or OPEN with the reason."""
    return (
        F.when(~F.col("closed"), F.concat(F.lit("OPEN - "), F.col("open_reason")))
        .when(F.col("note") != "", F.concat(F.lit("CLOSED, ATTENTION - "), F.col("note")))
        .otherwise("CLOSED")
    )


def row_status() -> Column:
    """What is left to do on an allocation row; empty when nothing."""
    return F.concat_ws(
        " | ",
        F.when(F.col("cost_center") == V.UNALLOCATED, "NO CENTRE").when(~F.col("in_map"), "NOT IN MAP"),
        F.when(F.col("n_unmatched") > 0, F.concat(F.col("n_unmatched"), F.lit(" unmatched"))),
        F.when(F.col("n_review") > 0, F.concat(F.col("n_review"), F.lit(" to review"))))


def detail_check(detail: DataFrame, charged: DataFrame) -> DataFrame:
    """C4: persons of an invoice's detail list against the persons charged.

    Both have invoice_no, sig, person; detail also feed. Each side is reduced
    to distinct persons first; names are listed only where the sides differ."""
    d = detail.filter("sig <> ''").groupBy(
        F.coalesce(F.nullif("invoice_no", F.lit("")), F.lit("(no invoice number)")).alias("invoice_no"),
        "feed", "sig").agg(F.max_by("person", F.struct("source_seq", "row_no")).alias("d_person"))
    c = charged.filter("sig <> '' and invoice_no <> ''").groupBy("invoice_no", "sig").agg(
        F.max_by("person", F.struct("source_seq", "row_no")).alias("c_person"))
    heads = d.select("invoice_no", "feed").distinct()
    c = c.join(heads, "invoice_no")
    j = d.join(c, ["invoice_no", "feed", "sig"], "full_outer")
    missing = F.when(F.col("c_person").isNull(), F.col("d_person"))
    surplus = F.when(F.col("d_person").isNull(), F.col("c_person"))
    return j.groupBy("invoice_no", "feed").agg(
        F.count("d_person").alias("n_detail"), F.count("c_person").alias("n_charged"),
        F.array_join(F.array_sort(F.collect_list(missing)), ", ").alias("missing"),
        F.array_join(F.array_sort(F.collect_list(surplus)), ", ").alias("surplus"),
    ).withColumn("consistent", (F.col("missing") == "") & (F.col("surplus") == ""))


def company_mismatch(parts: DataFrame) -> DataFrame:
    """Company on the label against the companies in the table, per pair.

    A line counts once for each table company when none of them is the label's."""
    label = F.coalesce(F.nullif(F.trim("site_label"), F.lit("")), F.col("inherited_label")) \
        if "inherited_label" in parts.columns else F.nullif(F.trim("site_label"), F.lit(""))
    p = parts.filter(F.col("decision") != V.UNMATCHED).withColumn("label_company", company_of(label)).filter(
        F.col("label_company").isNotNull())
    line = p.groupBy("source_seq", "row_no", "label_company", F.col("ccy").alias("currency")).agg(
        F.first("amount").alias("amount"),
        F.collect_set(F.nullif("company", F.lit(""))).alias("companies"))
    line = line.filter((F.size("companies") > 0) & ~F.array_contains("companies", F.col("label_company")))
    return line.withColumn("company", F.explode("companies")).groupBy(
        "currency", "label_company", "company").agg(
        F.count(F.lit(1)).alias("n_lines"), cents(F.sum("amount")).alias("amount"))


def totals(closed: DataFrame) -> DataFrame:
    """Totals per currency."""
    out = closed.groupBy("currency").agg(
        *[F.sum(m).cast(CENTS).alias(m) for m in ("read", "duplicate", "allocated", "unallocated")])
    net = (F.col("allocated") + F.col("unallocated")).cast(CENTS)
    return out.withColumn("net", net).withColumn(
        "rate", F.when(F.col("net") == 0, 0).otherwise(
            F.round(F.col("allocated") / F.col("net") * 100, 2)).cast("decimal(10,2)"))


def open_controls(closed: DataFrame) -> DataFrame:
    """Control rows that are open."""
    return closed.filter(~F.col("closed"))


def all_closed(closed: DataFrame) -> DataFrame:
    """Overall flag, one row."""
    return closed.agg(F.coalesce(F.bool_and("closed"), F.lit(True)).alias("closed"),
                      F.count_if(~F.col("closed")).alias("n_open"))


def release_gate(closed: DataFrame, rows: DataFrame, lines: DataFrame, suspicions: DataFrame = None,
                 conflicts: DataFrame = None, details: DataFrame = None, failed_files: DataFrame = None,
                 suggestions: DataFrame = None) -> DataFrame:
    """OPEN, CLOSED DRAFT, CLOSED ATTENTION or CLOSED, with the counts behind it.

    Each evidence table is reduced to one count; the counts are stacked and
    summed, so no table is paired with another."""
    counts = []

    def count(name, df, n=F.lit(1)):
        if df is not None:
            counts.append(df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n")).select(
                F.lit(name).alias("k"), "n"))

    yes = lambda c: F.when(c, 1).otherwise(0)
    expense = lines.filter(~F.coalesce("source_type", F.lit("")).isin(*V.REGISTER_TYPES, *V.DETAIL_TYPES))
    count("open", closed, yes(~F.col("closed")))
    count("undated", closed, F.col("n_undated"))
    count("amountless", closed, F.col("n_amountless"))
    count("review", expense, yes(F.col("decision") == V.REVIEW))
    count("unmatched", expense, yes(F.col("decision") == V.UNMATCHED))
    count("unmapped", rows, yes(~F.col("in_map")))
    count("suspicions", suspicions)
    count("conflicts", conflicts)
    count("details", details, yes(~F.col("consistent")) if details is not None else F.lit(1))
    count("failed", failed_files)
    count("suggestions", suggestions)
    stack = counts[0]
    for c in counts[1:]:
        stack = stack.unionByName(c)
    names = ["open", "failed", "review", "unmatched", "undated", "amountless", "unmapped", "suspicions",
             "conflicts", "details", "suggestions"]
    one = stack.agg(*[F.coalesce(F.sum(F.when(F.col("k") == n, F.col("n"))), F.lit(0)).alias(f"n_{n}") for n in names])
    attention = sum((F.col(f"n_{n}") for n in names[4:]), F.lit(0))
    gate = (
        F.when((F.col("n_open") > 0) | (F.col("n_failed") > 0), "OPEN")
        .when((F.col("n_review") > 0) | (F.col("n_unmatched") > 0), "CLOSED DRAFT")
        .when(attention > 0, "CLOSED ATTENTION")
        .otherwise("CLOSED")
    )
    return one.select(gate.alias("gate"), *[f"n_{n}" for n in names])
