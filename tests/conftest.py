import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from arcweave.runtime import local_session

    s = local_session(cores=4, shuffle_partitions=4, name="tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
