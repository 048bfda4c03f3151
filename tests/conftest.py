import pytest

from galleria.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, 4, **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("checkpoint"))})
    yield s
