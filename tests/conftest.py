import pytest

from turnloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
