"""Scratch tables need shared storage on a cluster."""

import pytest

from pathsift.llm import common


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_scratch_folder_of_a_cluster_is_the_shared_one():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_path(Session(spark_master="spark://host:7077"), "x")
    s = Session(spark_master="spark://host:7077")
    s.conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert common.scratch_path(s, "x").startswith("hdfs://shared/llm/x-")
    local = Session(spark_master="local[2]")
    assert common.scratch_path(local, "x").startswith(local.conf["spark.checkpoint.dir"])
