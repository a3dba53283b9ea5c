import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from meterloom.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield prepare(local_session(4, 4))
