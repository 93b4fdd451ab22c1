from types import SimpleNamespace

import pytest

from docketmill.ship import shared_folder


def fake(master, folder):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: folder), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_the_shared_folder_is_given_or_local_or_an_error():
    assert shared_folder(fake("spark://host:7077", "hdfs://a/b/")) == "hdfs://a/b"
    own = shared_folder(fake("local[4]", None))
    assert own.startswith("file:///") and shared_folder(fake("local", None)) == own
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(fake(master, None))
