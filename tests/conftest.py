import pytest

from quillspark.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(4, "4g", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
