import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from revlens.session import local_session
    return local_session(4, 4, app="revlens-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
