import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from plyforge.session import build_session

    where = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", "local[" + os.environ.get("TEST_CPUS", "8") + "]", 8,
        spark__ui__enabled="false", spark__sql__warehouse__dir=str(where / "warehouse"), spark__checkpoint__dir=f"file://{where}/checkpoint",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
