import os
import sys

import pytest

os.environ |= {"FORGE_USER": "u", "FORGE_SECRET": "s"}  # before the workers' parent starts

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from revlens.session import session

    s = session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="3g",
        spark__ui__showConsoleProgress="false",
        spark__sql__adaptive__enabled="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
