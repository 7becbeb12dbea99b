import pytest

from bazaarlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
