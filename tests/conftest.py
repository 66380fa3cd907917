import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from recoflow.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8)
    # tests own their checkpoint folder; a cluster names a shared one
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="recoflow-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="recoflow-test-", dir="/tmp")


SF_SMALL = "/root/testdata/sf0.001"
