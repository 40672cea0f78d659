import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# the Python workers import the functions under test by name
os.environ["PYTHONPATH"] = os.pathsep.join([*sys.path[:2], os.environ.get("PYTHONPATH", "")])

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session_ = session()
    session_.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session_
    session_.stop()
