import pytest

from attesta.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark(4, 4)
