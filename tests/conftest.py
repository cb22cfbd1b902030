import pytest

from railcorpus.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, 4, spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
