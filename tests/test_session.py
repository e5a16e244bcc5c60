import pytest

from sectorlens import session


class Fake:
    """A session with a master and settings, and no machine behind it."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = self, self
        self.master, self._folder = master, folder

    def get(self, key, default=None):
        return self._folder or default

    def getCheckpointDir(self):  # noqa: N802
        return None


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake(master))
    assert session.shared_dir(Fake(master, "hdfs:///shared")) == "hdfs:///shared"
    assert session.scratch_path(Fake(master, "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")


def test_local_mode_may_do_without(spark):
    assert session.is_local("local") and session.is_local("local[*]") and not session.is_local("local-cluster[1,1,1]")
    assert session.shared_dir(spark)
