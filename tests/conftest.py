import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loam.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local("tests", cores=4, partitions=4)
    yield session
    session.stop()
