import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from check_oracle import session

    s = session("tests", cores=4, memory="4g")
    yield s
    s.stop()
