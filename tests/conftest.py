import pytest

from lodeworks.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", partitions=4, memory="4g")
