import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from strata.session import local_session

    s = local_session(4, partitions=4, app="tests")
    yield s
    s.stop()
