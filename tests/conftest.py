import pytest

from talus.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.driver.memory": "4g"})
    yield s
    s.stop()
