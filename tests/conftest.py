import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
