"""Intermediate tables go to a shared folder or nowhere."""

import pytest
from ledgerloom.sources import scratch


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        self.path = path


class _Session:
    def __init__(self, master, named=None):
        self.sparkContext, self.named = _Context(master), named
        self.conf = self

    def get(self, key, default):
        return self.named or default


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(_Session(master))
    assert scratch.shared_folder(_Session(master, "hdfs://h/shared/")) == "hdfs://h/shared"


def test_stored_tables_are_in_the_shared_folder(spark):
    df = scratch.stored(spark.range(3), "three")
    assert df.count() == 3 and all(scratch.shared_folder(spark) in f for f in df.inputFiles())
