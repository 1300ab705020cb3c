"""Scratch folders: one that all executors share, or an error."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from ticklane.sources.scratch import scratch_root, written


def fake(master, folder):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda path: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))


def test_a_cluster_without_a_shared_folder_raises():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            scratch_root(fake(master, None))
    assert scratch_root(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch_root(fake("local[2]", None)).startswith("file:///")


def test_shuffle_files_go_when_what_they_made_is_written(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in disk.getAllFiles().mkString(" ").split() if "/shuffle_" in x}
    before = shuffled()
    made = written(spark.range(1000).groupBy(F.col("id") % 7).count().toDF("k", "n"), "freed")
    assert not shuffled() - before and made.count() == 7
