"""The shared folder: the cluster's setting, else a temporary folder in one JVM only; the package is sent once."""

from types import SimpleNamespace

import pytest

from barsmith import scratch, shipping


def session(master, found=None):
    conf = SimpleNamespace(get=lambda *a: found)
    return SimpleNamespace(conf=conf,
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: SimpleNamespace(get=lambda *a: None)))


def test_shared_folder():
    assert scratch.shared_dir(session("spark://h:7077", "hdfs://h/x/")) == "hdfs://h/x"
    own = scratch.shared_dir(session("local[4]"))
    assert own.startswith("file:///") and scratch.shared_dir(session("local[4]")) == own
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(session(master))


def test_package_is_sent_once(spark):
    shipping.ship(spark)
    before = len(spark.sparkContext.listFiles)
    shipping.ship(spark)
    assert len(spark.sparkContext.listFiles) == before >= 1
