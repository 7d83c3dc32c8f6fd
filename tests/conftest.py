import pytest

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=8, memory="12g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
