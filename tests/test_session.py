"""The checkpoint folder comes from the session; a local one is made only on a local master."""

import pytest

from wagelens.session import CLUSTER_CONF, checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, current=None):
        self.master = master
        self.current = current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


class _Session:
    def __init__(self, master, conf=None, current=None):
        self.sparkContext = _Context(master, current)
        self.conf = _Conf(conf or {})


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session("yarn"))


def test_cluster_folder_from_conf_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs://shared/ckpt"})
    assert checkpoint_dir(s) == "hdfs://shared/ckpt"
    assert s.sparkContext.current == "hdfs://shared/ckpt"


def test_local_master_gets_a_local_folder():
    s = _Session("local[4]")
    assert checkpoint_dir(s).startswith("/")


def test_cluster_settings_keep_aqe_on():
    assert CLUSTER_CONF["spark.sql.adaptive.enabled"] == "true"
    assert CLUSTER_CONF["spark.sql.adaptive.skewJoin.enabled"] == "true"
