import pytest

from tidewatch.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("local[4]", 4)
