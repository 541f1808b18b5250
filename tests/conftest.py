import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
