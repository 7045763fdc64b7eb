import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pkgpulse.session import build_session

    scratch = tempfile.mkdtemp(prefix="pkgpulse-tests-")
    session = build_session(
        "local[*]",
        app_name="pkgpulse-tests",
        shuffle_partitions=8,
        conf={"spark.checkpoint.dir": f"{scratch}/checkpoint"},
    )
    yield session
    session.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="pkgpulse-t-")
