"""One session for all tests."""

import pytest

from harrow.session import get_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", "harrow-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
