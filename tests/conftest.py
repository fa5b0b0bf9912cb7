import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parents[1], Path(__file__).resolve().parent):
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from statewise.session import local_session

    return local_session(shuffle_partitions=4)
