import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vaultlake.session import build_session

    s = build_session("local[4]", shuffle_partitions=4, app="vaultlake-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vaultlake-test-ckpt-"))
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
