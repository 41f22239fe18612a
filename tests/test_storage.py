import pytest

from manyfold.operators import storage


class Fake:
    """What ``shared_dir`` reads of a session."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_a_cluster_must_name_its_folder():
    assert storage.shared_dir(Fake("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x/manyfold-app-1"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            storage.shared_dir(Fake(master))


def test_local_sessions_get_a_folder_of_their_own():
    assert storage.shared_dir(Fake("local[4]")).startswith("file://") and storage.shared_dir(Fake("local")) == storage.shared_dir(Fake("local[*]"))


def test_materialise_and_release(spark):
    table = storage.materialise(spark.range(5))
    assert sorted(r.id for r in table.collect()) == list(range(5))
