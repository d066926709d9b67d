import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from daywise.session import local_session, ship

    session = local_session(cores=8, partitions=8, memory="6g")
    ship(session)
    yield session
    session.stop()
