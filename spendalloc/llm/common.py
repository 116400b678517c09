"""Helpers shared by the operators: shared intermediate tables and Arrow batches of bounded size."""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.common import write_table

TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local folder is made, but only for a local master:
    on a cluster executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts lineage without keeping anything on executors, so that a lost
    executor costs no more than the tasks it was running."""
    path = new_path(df.sparkSession, name)
    write_table(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more, in whatever store they lie."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_SHARED: list = []


def share(spark: SparkSession, value):
    """A broadcast that `forget` takes off the executors later."""
    _SHARED.append(spark.sparkContext.broadcast(value))
    return _SHARED[-1]


def forget() -> None:
    """Take earlier broadcasts off the executors; one that is needed again is sent again."""
    while _SHARED:
        _SHARED.pop().unpersist()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, whatever other columns there are; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def cut(batches, column: str | None = "text", rows: int = TEXT_ROWS, size: int = TEXT_BYTES):
    """Arrow batches cut so that each holds at most `rows` rows and about `size` bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        if column is None:
            yield from (b.slice(i, rows) for i in range(0, b.num_rows, rows))
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            done = ends[start - 1] if start else 0
            stop = min(max(int(np.searchsorted(ends, done + size, "right")), start + 1), start + rows)
            yield b.slice(start, stop - start)
            start = stop


def table(schema, **columns):
    """A record batch in the order of an Arrow schema."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, schema.field(n).type)
         for n, c in ((f.name, columns[f.name]) for f in schema)], schema=schema)


def append_columns(df: DataFrame, of, fields: str, text_col: str = "text", **cuts) -> DataFrame:
    """The rows of a table with further columns that `of` makes from the texts (a list, null as empty) of a batch.

    All other columns pass as they are, whatever their names; names in
    `fields` must be new."""
    extra = StructType.fromDDL(fields)
    if clash := {f.name for f in extra} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are already there")
    names = [f.name for f in extra]

    def run(batches):
        for b in cut(batches, text_col, **cuts):
            made = of([t or "" for t in b.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, made)], [*b.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *extra.fields]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
