"""Streaming queries, run over the whole event table until it is drained."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import CENTS, MONEY
from ..operators.common import work_dir
from ..streaming import flows
from . import views as V


def _folder(spark) -> str:
    return f"{work_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark, d) -> DataFrame:
    """Events as arriving expense lines: the type is the feed, its source the user."""
    schema = V.load(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(
        F.col("ts").cast("timestamp").alias("arrived"), F.col("event_type").alias("feed"), F.col("event_type").alias("source_file"),
        F.col("event_id").alias("row_no"), F.col("ts").cast("date").alias("doc_date"), F.col("props").alias("description"),
        F.col("user_id").cast("string").alias("person_raw"),
        F.when(F.col("event_id") % 10 != 0, F.col("value").cast(MONEY)).alias("amount"),
        F.when(F.col("user_id") % 2 == 0, "usd ").alias("currency"),
        F.when(F.col("user_id") % 3 == 0, "UNMATCHED").otherwise("AUTO").alias("decision"),
        F.col("user_id").cast("string").alias("staff_id"), F.lit(None).cast("string").alias("site_label"),
        F.lit(0).alias("source_seq"))


def stream_control(spark, d) -> DataFrame:
    """Control totals per day, feed and currency."""
    f = _folder(spark)
    q = flows.write_updates(flows.stream_control(_events(spark, d), width="1 day"), f"{f}/out", f"{f}/cp")
    q.awaitTermination()
    return flows.read_updates(spark, f"{f}/out").withColumn("start", F.col("start").cast("date"))


STREAM_CONTROL = """
SELECT CAST(ts AS DATE) AS start, event_type AS feed, CASE WHEN user_id % 2 = 0 THEN 'USD' ELSE '?' END AS ccy, count(*) AS n_lines,
       count(*) FILTER (event_id % 10 = 0) AS n_amountless,
       CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (event_id % 10 <> 0) AS DECIMAL(18,2)) AS read,
       coalesce(CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (event_id % 10 <> 0 AND user_id % 3 <> 0) AS DECIMAL(18,2)), 0) AS allocated,
       coalesce(CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (event_id % 10 <> 0 AND user_id % 3 = 0) AS DECIMAL(18,2)), 0) AS unallocated
FROM events GROUP BY 1, 2, 3"""


def stream_once(spark, d) -> DataFrame:
    """Each user, type and value once within the late window."""
    f = _folder(spark)
    once = flows.stream_once(_events(spark, d), late="365 days", cols=("feed", "person_raw", "amount"))
    q = flows.write_updates(once.select(F.col("arrived").alias("start"), "feed", F.col("content_key").alias("ccy"), "person_raw", "amount"),
                            f"{f}/out", f"{f}/cp")
    q.awaitTermination()
    return flows.read_updates(spark, f"{f}/out").select("feed", "person_raw", F.col("amount").cast(CENTS).alias("amount"))


STREAM_ONCE = """
SELECT DISTINCT event_type AS feed, CAST(user_id AS VARCHAR) AS person_raw,
       CAST(CASE WHEN event_id % 10 <> 0 THEN value END AS DECIMAL(18,2)) AS amount FROM events"""


def stream_resolve(spark, d) -> DataFrame:
    """Arriving lines resolved against the static roster."""
    f = _folder(spark)
    q = flows.stream_resolve(_events(spark, d).drop("decision", "feed"), V.snap(spark, d), V.cmap(spark, d), f"{f}/out", f"{f}/cp", synonyms={})
    q.awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{f}/out")
    return out.groupBy("site", "relation", "decision").agg(F.count(F.lit(1)).alias("n_lines"))


STREAM_RESOLVE = V.with_ctes("""
v_last AS (SELECT staff_id, arg_max(site, period) AS site FROM v_snap GROUP BY 1)
SELECT site, CASE WHEN site IS NULL THEN 'none' ELSE 'roster_stale' END AS relation,
       CASE WHEN site IS NULL THEN 'UNMATCHED' ELSE 'REVIEW' END AS decision, count(*) AS n_lines
FROM events LEFT JOIN v_last ON CAST(user_id AS VARCHAR) = staff_id GROUP BY ALL""", V.SNAP)
