import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesforge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app_name="seriesforge-tests")
    # Tests set their own shared folder (a cluster names one in spark.checkpoint.dir).
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seriesforge-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def workdir(tmp_path):
    """A fresh directory per test for the files it writes."""
    return str(tmp_path)


SMALL_SF = "/root/testdata/sf0.001"
ORACLE_SF = "/root/testdata/sf0.01"
