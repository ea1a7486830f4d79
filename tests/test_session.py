"""The shared working folder with and without the cluster's setting."""

import pytest

from wikimill import session


class FakeConf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class FakeSession:
    def __init__(self, master, value=None):
        self.conf = FakeConf(value)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_the_setting_wins():
    assert session.shared_dir(FakeSession("spark://host", "s3://bucket/work")) == "s3://bucket/work"


def test_a_local_session_gets_one_folder_of_its_own():
    s = FakeSession("local[4]")
    assert session.shared_dir(s) == session.shared_dir(s)


@pytest.mark.parametrize("master", ["spark://host", "yarn", "local-cluster[3,2,1000]"])
def test_a_cluster_without_the_setting_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession(master))
