"""Structured Streaming forms of run-to-run rules.

Family evidence needs the whole batch and stays out of streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import currency_key, source_name
from ..functions.values import CENTS
from ..operators.centers import resolve_lines

CONTENT = ("source_file", "row_no", "doc_date", "description", "person_raw", "amount", "currency")


def content_key(cols=CONTENT):
    """Key of a line's content; nulls and empty texts are kept apart."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cols]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def stream_once(lines: DataFrame, time: str = "arrived", late: str = "1 day", cols=CONTENT) -> DataFrame:
    """Every line once across batches; keys are held for the late window only."""
    return lines.withColumn("content_key", content_key(cols)).withWatermark(time, late).dropDuplicatesWithinWatermark(
        ["content_key"])


def stream_control(lines: DataFrame, time: str = "arrived", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Running control totals per feed and currency in tumbling windows (update mode).

    lines has feed, currency, amount, decision and the time column."""
    lost = F.col("decision") == V.UNMATCHED
    return lines.withWatermark(time, late).groupBy(F.window(time, width), "feed", currency_key("currency").alias("ccy")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("amount").isNull()).alias("n_amountless"),
        F.sum("amount").cast(CENTS).alias("read"),
        F.coalesce(F.sum(F.when(~lost, F.col("amount"))), F.lit(0)).cast(CENTS).alias("allocated"),
        F.coalesce(F.sum(F.when(lost, F.col("amount"))), F.lit(0)).cast(CENTS).alias("unallocated")).select(
        F.col("window.start").alias("start"), "feed", "ccy", "n_lines", "n_amountless", "read", "allocated", "unallocated")


def write_updates(totals: DataFrame, out: str, checkpoint: str):
    """Start a query that keeps each batch of updated totals under its batch number.

    A repeated batch replaces itself, so a restart leaves no doubles."""
    def save(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    return totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(save).start()


def read_updates(spark, out: str) -> DataFrame:
    """Latest totals per window, feed and currency."""
    u = spark.read.option("recursiveFileLookup", "true").parquet(out)
    key = ["start", "feed", "ccy"]
    rest = [c for c in u.columns if c not in (*key, "batch", "b")]
    return u.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


def route_late(lines: DataFrame, out: str, checkpoint: str, time: str = "arrived", late_seconds: int = 600):
    """Split each batch into lines on time and late lines (partition `is_late`).

    A line is late when it is older than the newest time of all earlier
    batches by more than the allowance. The newest times are kept as one row
    per batch, so a restarted query decides the same way."""
    spark = lines.sparkSession
    schema = "high timestamp, batch bigint"
    spark.createDataFrame([(None, -1)], schema).coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/b=start")

    def split(batch, batch_id):
        marks = batch.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/marks")
        high = marks.filter(F.col("batch") < batch_id).agg(F.max("high")).scalar()
        is_late = F.coalesce(F.col(time) < high - F.expr(f"INTERVAL {int(late_seconds)} SECONDS"), F.lit(False))
        marked = batch.withColumn("is_late", is_late)
        marked.write.mode("overwrite").partitionBy("is_late").parquet(f"{out}/lines/b={batch_id}")
        batch.agg(F.max(time).alias("high"), F.lit(batch_id).cast("bigint").alias("batch")).write.mode(
            "overwrite").parquet(f"{out}/marks/b={batch_id}")

    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(split).start()


def stream_resolve(lines: DataFrame, snap: DataFrame, cmap: DataFrame, out: str, checkpoint: str,
                   secondary: DataFrame = None, synonyms=None):
    """Resolve lines with a staff id batch by batch against the static roster.

    The roster's dated intervals are joined per batch; results of a batch
    replace themselves when it is repeated."""
    def save(batch, batch_id):
        m = batch.withColumns({
            "matched_name": F.lit(None).cast("string"), "norm": F.lit(""), "nid": F.lit(""),
            "method": F.when(F.col("staff_id").isNotNull(), "staff_id").otherwise("none"),
            "confidence": F.when(F.col("staff_id").isNotNull(), 1.0).otherwise(0.0)})
        resolve_lines(m, snap, cmap, secondary, synonyms=synonyms).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
