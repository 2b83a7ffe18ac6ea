import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from eventfold.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="eventfold-test-ckpt-")
    s = get_spark("local[4]", app="eventfold-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt})
    yield s


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="eventfold-test-")
