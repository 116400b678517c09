import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spendalloc.llm.common import stash
from spendalloc.operators.common import cut_lineage, work_dir


def session(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__),
                           sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            work_dir(session(master))
        assert work_dir(session(master, "hdfs://shared/x")) == "hdfs://shared/x"
    assert work_dir(session("local[4]"))


def test_shuffles_of_a_written_table_go(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}

    for write in (cut_lineage, lambda df: stash(df, "test")):
        before = shuffles()
        rows = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count().repartition(4)
        written = write(rows)
        end = time.time() + 20
        while time.time() < end and shuffles() - before:
            time.sleep(0.2)
        assert not shuffles() - before
        assert written.agg(F.sum("count")).first()[0] == 5000
