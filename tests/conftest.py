import pytest

from lattiq.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(app="tests", cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
