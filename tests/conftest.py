import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from foliant.session import local_session, ship

    session = local_session("4")
    ship(session)
    yield session
    session.stop()
