import pytest

from casario.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, shuffle_partitions=4, app="casario-tests")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return "/root/testdata/sf0.001"
