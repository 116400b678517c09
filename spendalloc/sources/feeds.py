"""Landing of feed files and what is known about files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import squeeze
from ..functions.values import CENTS, cents
from ..operators.common import cut_lineage
from .quotes import read_records

# Bytes 0xD0 0xDD 0xDE 0xF0 0xFD 0xFE differ between Latin-1 and the Turkish code page.
_LATIN, _TURKISH = "ÐÝÞðýþ", "ĞİŞğış"
DELIMITERS = (";", ",", "\t", "|")


def read_feeds(spark, path: str) -> DataFrame:
    """Delimited files of unknown charset and delimiter as rows with an array of cells.

    Lines are read as raw bytes by splits, so a large file is spread over
    tasks. A file is UTF-8 when all of its lines are, else the Turkish code
    page; its delimiter is the most frequent candidate of its first line. Quoted
    cells may hold line breaks (`quotes.read_records`)."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"))
    ok = F.is_valid_utf8(F.col("bytes").cast("string"))
    files = raw.groupBy("path").agg(
        F.bool_and(ok).alias("utf8"), F.min_by("bytes", F.struct("block", "at")).alias("first"))
    text = lambda b: F.when(F.col("utf8"), F.regexp_replace(F.col(b).cast("string"), "^﻿", "")).otherwise(
        F.translate(F.decode(F.col(b), "iso-8859-1"), _LATIN, _TURKISH))
    head = text("first")
    n = lambda d: F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))
    most = F.greatest(*[n(d) for d in DELIMITERS])
    delimiter = F.lit(",")
    for d in reversed(DELIMITERS):
        delimiter = F.when((n(d) == most) & (most > 0), d).otherwise(delimiter)
    files = files.withColumn("delimiter", delimiter).drop("first")
    files = cut_lineage(files.withColumn("source_seq", F.row_number().over(_by_path())))
    records = read_records(raw.join(files, "path").select("path", "block", "at", text("bytes").alias("text"), "delimiter"))
    name = F.element_at(F.split("path", "/"), -1)
    return records.join(files, "path").select(
        "source_seq", name.alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("sheet"),
        F.col("row").cast("int").alias("row"), "cells")


def _by_path():
    from pyspark.sql import Window
    # One row per file: the list of files of a run.
    return Window.orderBy("path")


def file_hashes(spark, path: str) -> DataFrame:
    """Content hash of each file."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"),
                    F.sha2("content", 256).alias("hash"))


def dedup_content(files: DataFrame) -> DataFrame:
    """S3: files whose content came earlier in the run; the first arrival stays.

    files has source_seq, file, hash. Adds first_file, null on the file that stays."""
    first = files.groupBy("hash").agg(F.min(F.struct("source_seq", "file")).alias("f"))
    j = files.join(first, "hash")
    return j.select(*files.columns, F.when(
        F.col("f.source_seq") != F.col("source_seq"), F.col("f.file")).alias("first_file"))


def dedup_same_name(lines: DataFrame) -> DataFrame:
    """A second file of the same name: a copy when row count and total agree, else a feed of its own.

    Adds copy_of (drop these) and source_label (a separate feed)."""
    name = F.trim(F.element_at(F.split("source_file", "> "), -1))
    l = lines.withColumn("_name", name)
    sig = l.groupBy("source_seq", "_name").agg(
        F.count(F.lit(1)).alias("n"), cents(F.coalesce(F.sum("amount"), F.lit(0))).alias("total"),
        F.min("source_file").alias("full"))
    first = sig.groupBy("_name").agg(F.min_by(F.struct("source_seq", "n", "total", "full"), "source_seq").alias("f"))
    j = sig.join(first, "_name")
    later = F.col("source_seq") != F.col("f.source_seq")
    same = later & (F.col("n") == F.col("f.n")) & (F.col("total") == F.col("f.total"))
    from pyspark.sql import Window
    w = Window.partitionBy("_name", "differs").orderBy("source_seq")
    j = j.withColumn("differs", later & ~same)
    j = j.withColumn("_k", F.when(F.col("differs"), F.row_number().over(w) + 1))
    label = F.when(F.col("differs"), F.when(F.col("full").contains("> "), F.col("full")).otherwise(
        F.concat(F.lit("copy-"), F.col("_k"), F.lit(" > "), F.col("_name"))))
    marks = j.select("source_seq", "_name", F.when(same, F.col("f.full")).alias("copy_of"), label.alias("source_label"))
    return l.join(marks, ["source_seq", "_name"]).drop("_name")


def seen_before(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files of this run that an earlier run has processed."""
    return files.join(ledger.select("hash").distinct(), "hash", "left_semi")


def append_processed(files: DataFrame, path: str, run_id: str) -> None:
    """Remember the files after success; one folder per run, so a repeat replaces only itself."""
    files.select("hash", "file").write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def mark_registers(lines: DataFrame) -> DataFrame:
    """A long generic feed without a single amount is a person register."""
    per = lines.groupBy("source_seq").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("amount").isNotNull()).alias("_paid"))
    j = lines.join(per, "source_seq")
    reg = (F.col("source_type") == V.GENERIC) & (F.col("_n") >= V.REGISTER_ROWS) & ~F.col("_paid")
    return j.withColumns({
        "register_reason": F.when(reg, F.concat(F.lit("none of "), F.col("_n"), F.lit(" lines has an amount")))
                            .when(F.col("source_type") == V.REFERENCE_LIST, "id and centre columns, no amount column"),
        "source_type": F.when(reg, V.REFERENCE_LIST).otherwise(F.col("source_type"))}).drop("_n", "_paid")


def flag_fallback(lines: DataFrame, wanted: str = "wanted_type") -> DataFrame:
    """Lines read by another reader than the feed's own carry a warning, which rules out AUTO."""
    other = F.col(wanted).isNotNull() & (F.col(wanted) != F.col("source_type"))
    return lines.withColumn("reader_warning", F.when(other, F.concat(
        F.lit("template "), F.col(wanted), F.lit(" not recognised, read as "), F.col("source_type"))))


OUTCOMES = ("READ", "REGISTER", "DETAIL", "NO LINES", "UNREADABLE", "STAFF DATA", "SAME CONTENT", "SKIPPED", "MESSAGE")


def inventory(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file with its outcome, counts, total and most common currency."""
    kinds = lines.groupBy("source_seq").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("amount").alias("n_with_amount"),
        cents(F.sum("amount")).alias("amount"), F.mode("currency", True).alias("currency"),
        F.bool_and(F.col("source_type").isin(*V.REGISTER_TYPES)).alias("all_register"),
        F.bool_and(F.col("source_type").isin(*V.DETAIL_TYPES)).alias("all_detail"))
    j = files.join(kinds, "source_seq", "left")
    given = F.col("first_file") if "first_file" in files.columns else F.lit(None).cast("string")
    outcome = (F.when(given.isNotNull(), "SAME CONTENT").when(F.col("n_lines").isNull(), "NO LINES")
               .when(F.col("all_detail"), "DETAIL").when(F.col("all_register"), "REGISTER").otherwise("READ"))
    gap = F.col("n_lines") - F.col("n_with_amount")
    reason = (F.when(outcome == "SAME CONTENT", F.concat(F.lit("same content as "), given))
              .when(outcome == "NO LINES", "opened, but no lines")
              .when((outcome == "READ") & (gap > 0), F.concat(gap, F.lit(" lines without amount"))).otherwise(""))
    return j.select(
        "source_seq", "file", outcome.alias("outcome"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("n_with_amount", F.lit(0)).alias("n_with_amount"), "amount", "currency", reason.alias("reason"))


def outcome_counts(inv: DataFrame) -> DataFrame:
    """Files per outcome, in display order."""
    order = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("outcome"))
    return inv.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_files")).orderBy(order)
