"""Records of quoted cells over several lines against a reader that goes through each file."""

import csv
import io
import random

from pyspark.sql import functions as F

from spendalloc.sources import feeds
from spendalloc.sources.quotes import read_records

SCHEMA = "path string, block long, at long, text string, delimiter string, row string"


def read(lines, delimiter):
    return list(csv.reader(lines, delimiter=delimiter))


def table(spark, files):
    """files: path -> (lines, delimiter, block starts)."""
    rows, at = [], 0
    for path, (lines, delimiter, cuts) in files.items():
        block = 0
        for i, t in enumerate(lines):
            if i in cuts:
                block, at = block + 1, at + 1000
            rows.append((path, block, at, t, delimiter, "other"))
            at += 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_as_a_sequential_reader(spark):
    rnd = random.Random(4)
    files = {}
    for f in range(12):
        d = rnd.choice([";", ",", "\t", "|"])
        parts = ["a", "b c", d, d, '"', '"', '""', "", f'{d}"', f'"{d}', "çğ"]
        lines = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 7))) for _ in range(150)]
        files[f"f{f}"] = (lines, d, set(rnd.sample(range(150), 6)))
    files["open"] = (['x;"never', "closed", "", "end"], ";", {2})
    files["blank"] = (["", "", "a"], ";", set())
    got = read_records(table(spark, files), chunk_rows=7).collect()
    for path, (lines, d, _) in files.items():
        mine = sorted((r["row"], r["cells"]) for r in got if r["path"] == path)
        assert mine == list(enumerate(read(lines, d))), path


def test_empty_table_and_null_lines(spark):
    t = table(spark, {"f": (["a;b", None, '"c', None, 'd"'], ";", set())})
    assert {r["row"]: r["cells"] for r in read_records(t).collect()} == {0: ["a", "b"], 1: [], 2: ["cd"]}
    assert read_records(t.limit(0)).count() == 0


def test_files_in_small_splits(spark, tmp_path):
    rnd = random.Random(9)
    want = {}
    for name in ("a", "b"):
        rows = [["no", "text"]] + [[str(i), "".join(rnd.choice('ab";\n ,') for _ in range(rnd.randint(0, 30)))]
                                   for i in range(400)]
        out = io.StringIO()
        csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
        (tmp_path / f"{name}.csv").write_text(out.getvalue())
        want[f"{name}.csv"] = read(out.getvalue().split("\n")[:-1], ";")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read_all = feeds.read_feeds(spark, str(tmp_path))
        got = read_all.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for file, rows in want.items():
        assert sorted((r["row"], r["cells"]) for r in got if r["file"] == file) == list(enumerate(rows))
    assert read_all.filter(F.size("cells") != 2).count() == 0
