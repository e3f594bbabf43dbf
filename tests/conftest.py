import pytest

from check_oracle import connect
from panelwright.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "8")


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
