"""The shared folder, with and without the setting that names it."""

import pytest

from tablewarden import runtime


class Conf(dict):
    def set(self, name, value):
        raise AssertionError("the setting belongs to the session")


class Session:
    """As much of a session as the folder depends on."""

    def __init__(self, application, **conf):
        self.conf = Conf({k.replace("__", "."): v for k, v in conf.items()})
        self.sparkContext = type("Context", (), {"applicationId": application})


def test_the_setting_counts():
    assert runtime.shared_dir(Session("a", spark__checkpoint__dir="hdfs://x/y/")) == "hdfs://x/y"


def test_a_local_session_gets_one_folder():
    session = Session("test-local", spark__master="local[2]")
    made = runtime.shared_dir(session)
    assert made == runtime.shared_dir(session) != runtime.shared_dir(Session("test-other", spark__master="local"))


def test_a_cluster_needs_the_setting():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session("b", spark__master="spark://host:7077"))
