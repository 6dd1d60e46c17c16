import pytest

from wardframe.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", master="local[8]",
        **{
            "spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
