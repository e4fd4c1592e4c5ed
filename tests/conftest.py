import pytest

from brevis.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="6g", partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
