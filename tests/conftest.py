import pytest

from gleaner.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "gleaner-tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
