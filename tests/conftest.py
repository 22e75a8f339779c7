from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def spark():
    from keymoment.session import build_session

    s = build_session("tests", "local[8]", 4, spark__ui__enabled="false", spark__driver__memory="6g", spark__sql__autoBroadcastJoinThreshold="256k")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
