import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siltstone.session import local_session, ship  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables."""
    if not os.path.isdir(f"{DATA}/sf0.001"):
        pytest.skip("no driver tables here")
    return f"{DATA}/sf0.001"
