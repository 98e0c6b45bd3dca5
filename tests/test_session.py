import pytest

from inkfold.session import shared_dir


class Fake:
    """A session of another master, with or without the shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.conf = self
        self.master, self.folder = master, folder

    def getConf(self):  # noqa: N802
        return self

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_the_shared_folder_is_the_session_s_own():
    assert shared_dir(Fake("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y/inkfold"
    assert shared_dir(Fake("local[4]")) == "file:///tmp/checkpoints/inkfold"
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Fake(master))
