import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from foliograph.session import build_session

    # Tables of a few rows: compiling plans would take longer than running them.
    session = build_session(
        "local[2]",
        "tests",
        spark__sql__shuffle__partitions="2",
        spark__driver__memory="4g",
        spark__sql__codegen__wholeStage="false",
        spark__sql__codegen__factoryMode="NO_CODEGEN",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
