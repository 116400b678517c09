"""Shared building blocks: lineage cuts and ranks that survive hot groups."""

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16


def work_dir(spark) -> str:
    """Shared folder for intermediate tables, as named by the cluster.

    Only when the session names none and the master is this machine (tests), a
    local one is used; on a cluster, executors would each write to their own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spendalloc-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write an intermediate table; the shuffles that made it leave the executors' disks with the end of the write.

    Otherwise they stay until the driver's memory is collected, which may be
    after the job. A session that has asked for this itself keeps its setting."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN_UP, "false")
    conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN_UP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table and read it back.

    Later stages neither recompute it nor depend on the executors that made
    it, and the optimiser sees its real size."""
    path = f"{work_dir(df.sparkSession).rstrip('/')}/spendalloc-{uuid.uuid4().hex}"
    write_table(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of `cut_lineage` that nothing reads any more, in whatever store they lie."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_KEPT: list = []


def keep(df: DataFrame) -> DataFrame:
    """Keep a table on the executors' disks, dealt as it is; the one kept before leaves them.

    Unlike a written table it meets itself under its keys without another
    shuffle. A lost part is computed again."""
    while _KEPT:
        before = _KEPT.pop()
        if before.sparkSession.sparkContext is df.sparkSession.sparkContext:
            before.unpersist()
    _KEPT.append(df.persist(StorageLevel.DISK_ONLY))
    return _KEPT[-1]


def block_row_number(df: DataFrame, group, order, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`row_number` within `group`, without sorting a whole group in one task.

    `order` is a list of columns whose last one is an integer that is unique
    within the others (a row number). Rows are ranked inside blocks of that
    integer; the block sizes, counted with a map-side combine, give the offset
    of each block. A group of any size is spread over its blocks, and only one
    count per block is ever brought together. The block width follows the
    spread of the integer, so that a block holds about `block_rows` rows even
    when the numbers have gaps."""
    *lead, last = order
    n_blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows))
    width = df.agg(F.greatest(F.lit(1), F.ceil((F.max(last) - F.min(last) + 1) / n_blocks)).cast("bigint")).scalar()
    blocked = df.withColumn("_block", F.floor(F.col(last) / width))
    keys = [*group, *lead, "_block"]
    sizes = blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*lead, "_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = blocked.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(last)))
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_offset")
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = ranked.join(offsets, cond, "inner")
    return joined.withColumn(name, F.col("_in") + F.col("_offset")).drop(
        "_block", "_in", "_offset", *[f"_k{i}" for i in range(len(keys))])


def top_per_group(df: DataFrame, group, order, k: int, rank: str = "_rank") -> DataFrame:
    """First k rows per group; the limit is applied before the shuffle too."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
