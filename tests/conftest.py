import pytest

from corpusloom.session import build


@pytest.fixture(scope="session")
def spark():
    s = build("tests", 3, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield s
    s.stop()
