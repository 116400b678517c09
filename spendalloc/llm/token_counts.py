"""Token counts with a digest cache.

A text's content digest and the tokenizer's version digest are the key of a
stored count. Texts are keyed, distinct keys that the cache lacks are encoded
once and appended, and every document takes its count from the cache.

Null and empty texts count as empty (0 tokens). Repeated rows each get a row.
Texts of any length are encoded whole. An empty table gives an empty result.
Columns other than id and text are ignored."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, new_path, table
from .encoders import encoder, load_file

CACHE = "tokenizer string, digest binary, n_tokens long"


def _encode_misses(kind, content, version):
    schema = pa.schema([("tokenizer", pa.string()), ("digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches):
        enc = encoder(kind, content.value, version)
        for b in cut(batches):
            counts = [enc.count(t) for t in b.column("text").to_pylist()]
            yield table(schema, tokenizer=[version] * len(counts), digest=b.column("digest"), n_tokens=counts)

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, cache_path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row.

    `cache_path` names a table of counts that is read first and appended to;
    one run at a time may append. Without it a new table is used."""
    spark = docs.sparkSession
    kind, content, version = load_file(tokenizer_path)
    cache_path = cache_path or new_path(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    keyed = id_text(docs, id_col, text_col).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"),
        "text")
    known = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version)
    # One text per digest, reduced before the shuffle, so that many copies of one text do not meet.
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
    encoded = misses.mapInArrow(_encode_misses(kind, spark.sparkContext.broadcast(content), version), CACHE)
    encoded.write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version)
    return keyed.select("doc_id", "digest", "n_bytes").join(
        counts.select("digest", "n_tokens"), "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
