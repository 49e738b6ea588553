import pytest

from palimpsest.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests", driver_memory="8g")
    yield session
    session.stop()
