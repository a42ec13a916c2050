import pytest

from shelfwise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "8g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
