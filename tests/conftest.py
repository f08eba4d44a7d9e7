import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mapweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 2, **{"spark__checkpoint__dir": tempfile.mkdtemp(prefix="mapweave-test-"),
                                              "spark__driver__memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
