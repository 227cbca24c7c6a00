import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as entry

    session = entry.session("local[8]", "6g")
    yield session
    session.stop()
