"""One session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import build_session

    s = build_session("local[4]", "ledgerloom-tests", shuffle_partitions=4, spark__driver__memory="3g", spark__sql__maxMetadataStringLength="200")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA
