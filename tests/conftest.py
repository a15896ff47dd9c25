import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kinetable.session import local_session

    session = local_session(4, "6g", 4)
    yield session
    session.stop()
