import pytest

from flowloom import session


class Fake:
    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = {"spark.checkpoint.dir": folder}


def test_checkpoint_folder():
    assert session.checkpoint_folder(Fake("spark://h:7077", "hdfs:///shared")) == "hdfs:///shared"
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.checkpoint_folder(Fake(master))
    assert session.checkpoint_folder(Fake("local[4]"))
