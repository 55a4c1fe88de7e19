import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from threatsift.session import get_spark

    ckpt = tempfile.mkdtemp(prefix="threatsift-test-")
    s = get_spark("local[4]", app_name="threatsift-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt, "spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
