import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def empty(spark):
    from odd import frame

    return frame(spark, [])
