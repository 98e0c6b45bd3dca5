import pytest

from inkfold.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "3g")
    yield session
    session.stop()
