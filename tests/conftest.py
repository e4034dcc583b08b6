import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from kgspark.session import get_session

    session = get_session("4", 4, "4g")
    yield session
    session.stop()
