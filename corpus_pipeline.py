"""From raw documents to packed sequences: five stages, each written before the next reads it.

Each stage is read after it was written, so it takes the broadcasts of the stages
before off the executors. Rows are documents; rows that repeat an id are one document for the stages that
drop by id. Null ids are never dropped for a copy or a leak."""

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendalloc.llm.bloom import without_ids
from spendalloc.llm.common import forget, read, stash
from spendalloc.llm.decontaminate import decontaminate
from spendalloc.llm.language_mix import language_mix
from spendalloc.llm.line_dedup import line_dedup
from spendalloc.llm.packing import best_fit_packing, token_lengths
from spendalloc.llm.set_join import similar_components

#: The least share of a document that its main language must have.
MIN_SHARE = 0.5
#: Lines found in so many documents stay in the first of them only.
MIN_LINE_DOCS = 10
#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 500
#: The file whose tokens sequences are packed in.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def begin(spark) -> None:
    """Before a stage: broadcasts of earlier stages leave the executors, and Arrow batches get a bound in rows.

    Spark's own bound, 10,000 rows, holds a whole partition of long texts in memory outside
    the heap, on both sides of the pipe; a smaller bound of the session stays."""
    forget()
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, min(BATCH_ROWS, int(spark.conf.get(rows)) if int(spark.conf.get(rows)) > 0 else BATCH_ROWS))


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language has half, go."""
    begin(spark)
    # Columns that are named like the operator's own step aside meanwhile.
    aside = {c: f"_kept_{c}" for c in docs.columns if c in ("lang_pred", "score", "mixture")}
    found = language_mix(docs.withColumnsRenamed(aside), keep_columns=True)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but for their first document; a document of nothing but such lines goes with them."""
    begin(spark)
    cut = line_dedup(docs, MIN_LINE_DOCS, keep="first", keep_columns=True)
    left = cut.filter((F.col("_llm_dropped") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("_llm_dropped") == 0, F.col("n_chars")).otherwise(
        F.length("text"))).select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with similarity 0.8 or more, the one with the smallest id stays."""
    begin(spark)
    groups = similar_components(docs, width=5, percent=80)
    return without_ids(docs, groups.filter("component_id < doc_id").select("doc_id")).select(*docs.columns)


def benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    begin(spark)
    leaks = stash(decontaminate(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return without_ids(docs, leaks).select(*docs.columns)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    begin(spark)
    return best_fit_packing(token_lengths(docs, TOKENIZER))


STAGES = [("language_id", language_id), ("line_dedup", repeated_lines), ("near_duplicates", near_duplicates),
          ("decontaminate", benchmark_leaks), ("packing", packed)]

#: SQL has no words for the estimation, decomposition and packing inside; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
