import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from maplift.session import get_spark
    s = get_spark("local[4]", 8, app="maplift-tests")
    # tests only: the shared folder is unset locally, so use a scratch one
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="maplift-test-"))
    yield s
    s.stop()
