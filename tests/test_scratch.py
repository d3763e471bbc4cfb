from types import SimpleNamespace

import pytest

from rootspan import scratch


def session(master, conf=None, checkpoint=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: conf or other), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(session("yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(session("local-cluster[2,1,1024]"))
    assert scratch.scratch_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch.scratch_dir(session("yarn", None, "hdfs://x/z")) == "hdfs://x/z"
    assert scratch.scratch_dir(session("local[2]")).startswith("file:///")


def test_passing_tables_go(spark):
    def made():
        first = scratch.materialize(spark.range(10).toDF("a"), "first")
        paths.append(first.inputFiles()[0])
        return first.where("a > 4")

    paths: list[str] = []
    out = scratch.materialize_alone(spark, made)
    assert out.count() == 5
    place = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    table, n = scratch.materialize_counted(spark.range(7).toDF("a"))
    assert n == 7 == table.count()
    assert scratch.materialize_counted(spark.range(0).toDF("a"))[1] == 0


def test_a_failed_stage_leaves_nothing(spark):
    def made():
        first = scratch.materialize(spark.range(10).toDF("a"), "first")
        paths.append(first.inputFiles()[0])
        raise ValueError("no")

    paths: list[str] = []
    with pytest.raises(ValueError, match="no"):
        scratch.materialize_alone(spark, made)
    place = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
