import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = {"0.001": "/root/testdata/sf0.001", "0.01": "/root/testdata/sf0.01"}


@pytest.fixture(scope="session")
def spark():
    from densitykit.session import get_session

    s = get_session(master="local[4]", shuffle_partitions=4,
                    checkpoint_dir=tempfile.mkdtemp(prefix="densitykit-test-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck001():
    from tests.harness import duck

    return duck(SF["0.001"])


def points_df(spark, rows, k=2):
    """Inline point rows ``(id, x0, ..)``."""
    cols = ", ".join(["id BIGINT"] + [f"x{i} DOUBLE" for i in range(k)])
    return spark.createDataFrame(rows, cols)
