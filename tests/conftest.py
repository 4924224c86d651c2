import pytest

from notegraph.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("local[4]", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
