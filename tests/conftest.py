import os

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # the dense checks are small
import sys  # noqa: E402

import pytest  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from curvewise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, app="tests")
    yield session
    session.stop()
