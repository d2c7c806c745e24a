import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from raresight.session import get_session, release_scratch  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 8, 8)
    yield session
    release_scratch(session)


@pytest.fixture(scope="session")
def sf():
    return SF
