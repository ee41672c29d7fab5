import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from retainx.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app="retainx-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    from oracle_compare import duck as connect
    return connect(SF_SMALL)
