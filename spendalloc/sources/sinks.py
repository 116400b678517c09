"""Tables for delivery."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import source_name
from ..operators.reconcile import row_status
from ..operators.rollup import feed_share, period_label

LINE_COLUMNS = (
    "source", "row_no", "doc_date", "category", "description", "person_raw", "staff_id", "matched_name", "method",
    "confidence", "candidate_count", "match_note", "period", "relation", "site", "cost_center", "cost_center_name",
    "company", "status", "staff_category", "exit_date", "amount", "currency", "site_label", "doc_no", "mail_subject",
    "decision", "warnings")
ALLOCATION_COLUMNS = (
    "feed", "company", "cost_center", "cost_center_name", "category", "share_note", "amount", "currency",
    "feed_share", "n_lines", "n_persons", "n_auto", "n_review", "n_unmatched", "period", "labels", "doc_numbers", "status")


def line_table(df: DataFrame) -> DataFrame:
    """Resolved lines, 28 columns in a fixed order.

    UNMATCHED money is shown where the allocation table has it; the weak
    proposal moves to the warnings."""
    for c in ("status", "staff_category", "doc_no", "mail_subject", "match_note", "description"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    company = F.coalesce("company", "company2")
    weak = (F.col("decision") == V.UNMATCHED) & (F.col("cost_center").isNotNull() | company.isNotNull())
    note = F.concat(F.lit("not allocated, shown under "), F.lit(V.UNALLOCATED), F.lit("; weak proposal: "),
                    F.coalesce("cost_center", F.lit("-")), F.lit(" / "), F.coalesce(company, F.lit("-")))
    warnings = F.concat_ws(" | ", F.col("warnings"), F.when(weak, note))
    return df.withColumns({
        "source": source_name("source_file"), "company": F.when(~weak, company).otherwise(""), "warnings": warnings,
        "cost_center": F.when(weak, V.UNALLOCATED).otherwise(F.col("cost_center")),
        "cost_center_name": F.when(weak, "").otherwise(F.col("cost_center_name"))}).select(*LINE_COLUMNS)


def allocation_table(rows: DataFrame) -> DataFrame:
    """Allocation rows, 18 columns in a fixed order."""
    return feed_share(rows).withColumns({
        "company": F.coalesce(F.nullif("company", F.lit("")), F.lit("(no company)")), "period": period_label(),
        "status": row_status(), "labels": F.coalesce("labels", F.lit("")),
        "doc_numbers": F.coalesce("doc_numbers", F.lit(""))}).select(*ALLOCATION_COLUMNS)


def _write(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path, sep=";") if fmt == "csv" else w.format(fmt).save(path)


def export_lines(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the line table, by default as `;` CSV."""
    _write(line_table(df), path, fmt)


def export_allocation(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the allocation table."""
    _write(allocation_table(rows), path, fmt)
