import pytest

from pkgpulse.llm.shared import ship


@pytest.fixture(scope="session", autouse=True)
def _shipped(spark):
    ship(spark)
