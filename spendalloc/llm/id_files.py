"""Token-ID output: files of coded id blocks in document order, and their reader.

Documents are dealt to ranges of ascending doc_id (equal ids by a hash of the
text), encoded, and appended to segments. A segment is a row of a table of
files: the blocks of `id_coder`, one after another, and an index of the
documents in it (id, number of ids). Every block is coded and checked on its
own. Segments end where documents end; one holds about SEGMENT ids, or one
document that has more.

Null and empty texts have no ids but the end id. Null doc_ids come first.
Rows that repeat an id are documents of their own. An empty table gives an
empty table of files; extra columns are ignored."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_text, new_path, table
from .encoders import encoder, load_file
from .id_coder import decode, encode, split

SEGMENT = 1 << 21
PART_BYTES = 32 << 20
FILES = "part long, segment long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _write(kind, content, version, end_id, segment_ids):
    schema = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, part, segment = encoder(kind, content.value, version), TaskContext.get().partitionId(), 0
        docs, lengths, ids, size = [], [], [], 0

        def close():
            data = np.frombuffer(b"".join(ids), "<u4")
            return table(schema, part=[part], segment=[segment], n_ids=[len(data)], doc_ids=[docs], lengths=[lengths],
                         payload=[b"".join(encode(data))])

        for b in cut(batches):
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = enc.ids(t) + end
                docs.append(doc)
                lengths.append(len(own) // 4)
                ids.append(own)
                size += len(own) // 4
                if size >= segment_ids:
                    yield close()
                    docs, lengths, ids, size, segment = [], [], [], 0, segment + 1
        if docs:
            yield close()
    return run


def write_ids(docs: DataFrame, tokenizer_path: str, out_path: str, end_id: int = 2, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Write the files and return the table of them as read back."""
    spark = docs.sparkSession
    kind, content, version = load_file(tokenizer_path)
    d = id_text(docs, id_col, text_col)
    size = d.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    ordered = d.withColumn("mark", F.xxhash64("text")).repartitionByRange(
        max(1, -(-size // PART_BYTES)), "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")
    ordered.select("doc_id", "text").mapInArrow(
        _write(kind, spark.sparkContext.broadcast(content), version, end_id, SEGMENT), FILES).write.parquet(out_path)
    return read_files(spark, out_path)


def read_files(spark, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def _documents(with_ids):
    fields = [("part", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()),
              ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("part", "segment", "n_ids", "doc_ids", "lengths", "payload")}
                ids = decode(split(row["payload"]))
                ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                if len(ids) != row["n_ids"] or (len(ends) and ends[-1] != len(ids)):
                    raise ValueError("a segment does not hold the ids of its documents")
                raw = ids.astype("<u4").tobytes()
                starts = ends - row["lengths"]
                n = len(ends)
                columns = {"part": [row["part"]] * n, "segment": [row["segment"]] * n, "doc_id": row["doc_ids"],
                           "at": starts, "n_tokens": row["lengths"],
                           "ids_crc32": [zlib.crc32(memoryview(raw)[4 * a:4 * e]) for a, e in zip(starts, ends)]}
                if with_ids:
                    columns["ids"] = [ids[a:e].tolist() for a, e in zip(starts, ends)]
                yield table(schema, **columns)
    return run


def read_documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files."""
    schema = "part long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long" + (
        ", ids array<long>" if with_ids else "")
    docs = files.mapInArrow(_documents(with_ids), schema)
    # One row for each segment of millions of ids: few rows, even for very many documents.
    before = Window.orderBy("_part", "_segment").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select(F.col("part").alias("_part"), F.col("segment").alias("_segment"), "n_ids").withColumn(
        "base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("n_ids")
    return docs.join(base, (F.col("part") == F.col("_part")) & (F.col("segment") == F.col("_segment"))).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def id_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out_path: str | None = None) -> DataFrame:
    """Write the files, to a folder of the shared place unless named, and read every document back."""
    return read_documents(write_ids(docs, tokenizer_path, out_path or new_path(docs.sparkSession, "id-files"), end_id))
