import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from chainweft.session import local_session

    session = local_session(cores=4, shuffle_partitions=4)
    yield session
    session.stop()
