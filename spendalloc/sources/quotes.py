"""Records of delimited files whose quoted cells hold line breaks, without a reader per file.

A line maps the state before it (outside or inside a quoted cell) to the state
after it. Such a map keeps the state, swaps it or sets it, so the state before
any line is the value of the last line that sets it, swapped as often as lines
since then swap. Lines are scanned in chunks under both assumptions; one row
per chunk then tells which of them holds, and only lines of records that take
several lines meet again."""

import csv
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import cut_lineage

CHUNK_ROWS = 1 << 14


def _reader(lines, delimiter):
    csv.field_size_limit(sys.maxsize)
    return csv.reader(lines, delimiter=delimiter)


def _stays_open(line: str, delimiter: str) -> bool:
    """Whether a quoted cell of the line goes on in the next one, which then is no record of its own."""
    return sum(1 for _ in _reader([line, ""], delimiter)) == 1


def _line_maps(batches):
    """Adds the state after each line, if it starts outside (open0) and inside (open1) a quoted cell."""
    for b in batches:
        rows = list(zip(b.column("text").to_pylist(), b.column("delimiter").to_pylist()))
        open0 = pa.array([_stays_open(t, d) for t, d in rows], pa.bool_())
        open1 = pa.array([_stays_open('"' + t, d) for t, d in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([*b.columns, open0, open1], [*b.schema.names, "open0", "open1"])


def _cells(batches):
    """Cells of records that are given as lists of lines."""
    for b in batches:
        cells = [next(_reader(lines, d), []) for lines, d in zip(
            b.column("lines").to_pylist(), b.column("delimiter").to_pylist())]
        keep = [n for n in b.schema.names if n != "lines"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(cells, pa.list_(pa.string()))],
                                         [*keep, "cells"])


def _state_before(open0: str, open1: str, group, order, start: Column) -> Column:
    """State before each row of a group that begins in state `start`."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col(open0) & ~F.col(open1)).cast("int")
    # What a row sets, as the state that the group would have needed at its start for it.
    even = F.sum(swap).over(upto) % 2 == 0
    sets = F.when(F.col(open0) == F.col(open1), F.col(open0) == even)
    odd = F.coalesce(F.sum(swap).over(before), F.lit(0)) % 2 == 1
    return F.coalesce(F.last("_sets", ignorenulls=True).over(before), start) != odd, sets


def _with_states(df: DataFrame, open0: str, open1: str, group, order, starts: dict) -> DataFrame:
    """Adds, for each name in `starts`, the state before each row if the group starts in that state."""
    made = {n: _state_before(open0, open1, group, order, s) for n, s in starts.items()}
    df = df.withColumn("_sets", next(iter(made.values()))[1])
    return df.withColumns({n: state for n, (state, _) in made.items()}).drop("_sets")


def read_records(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """path, row (from 0), cells: the records of files given as lines with path, block, at, text, delimiter.

    `block` and `at` order the lines of a file; `at` is an integer. The rules
    are those of the csv module, read file by file: a quote opens a cell only
    at its beginning, doubled quotes stand for one, line breaks inside a quoted
    cell are dropped, a cell that is never closed ends with the file, and an
    empty line is a record without cells. A null text is an empty line. Other
    columns are ignored; a file without lines has no record. One record must
    fit into a row, so a quote that is never closed makes the rest of its file
    one row."""
    lines = lines.select("path", "block", "at", F.coalesce("text", F.lit("")).alias("text"), "delimiter")
    # Lines without a quote keep the state; only the others need to be scanned.
    quoted = F.col("text").contains('"')
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    scanned = lines.filter(quoted).mapInArrow(_line_maps, f"{names}, open0 boolean, open1 boolean").unionByName(
        lines.filter(~quoted).withColumns({"open0": F.lit(False), "open1": F.lit(True)}))

    chunk = ["path", "block", "chunk"]
    c = scanned.withColumn("chunk", F.floor(F.col("at") / chunk_rows))
    c = _with_states(c, "open0", "open1", chunk, ["at"], {"in0": F.lit(False), "in1": F.lit(True)})
    upto = Window.partitionBy(*chunk).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = cut_lineage(c.withColumns({f"n{i}": F.sum((~F.col(f"in{i}")).cast("long")).over(upto) for i in (0, 1)}))

    # One row per chunk: where it leads to and how many records begin in it, from either state.
    after = lambda i: F.max_by(F.when(F.col(f"in{i}"), F.col("open1")).otherwise(F.col("open0")), "at")
    ends = c.groupBy(*chunk).agg(after(0).alias("end0"), after(1).alias("end1"),
                                 F.max("n0").alias("all0"), F.max("n1").alias("all1"))
    ends = _with_states(ends, "end0", "end1", ["path"], ["block", "chunk"], {"inside": F.lit(False)})
    earlier = Window.partitionBy("path").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("all", F.when(F.col("inside"), F.col("all1")).otherwise(F.col("all0"))).select(
        *chunk, "inside", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("offset"))

    placed = c.join(cut_lineage(ends), chunk)
    which = lambda a: F.when(F.col("inside"), F.col(f"{a}1")).otherwise(F.col(f"{a}0"))
    placed = placed.select("path", "delimiter", "block", "at", "text", which("in").alias("goes_on"), (
        which("n") + F.col("offset") - 1).alias("row"), F.when(which("in"), F.col("open1")).otherwise(
        F.col("open0")).alias("open"))
    alone = ~F.col("goes_on") & ~F.col("open")
    plain = placed.filter(alone & ~quoted).select("path", "row", F.when(
        F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", F.concat(
            F.lit("["), F.col("delimiter"), F.lit("]")), F.lit(-1))).alias("cells"))
    single = placed.filter(alone & quoted).select("path", "row", "delimiter", F.array("text").alias("lines"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    several = placed.filter(~alone).groupBy("path", "row", "delimiter").agg(
        F.transform(parts, lambda p: p["text"]).alias("lines"))
    return plain.unionByName(single.unionByName(several).mapInArrow(
        _cells, "path string, row long, delimiter string, cells array<string>").select("path", "row", "cells"))
