from types import SimpleNamespace

import pytest

from engram.llm.common import shared_dir


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_the_cluster_must_name_the_shared_folder():
    assert shared_dir(session("spark://host:7077", "hdfs:///x/")) == "hdfs:///x"
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("local[4]")) == shared_dir(session("local[4]"))
