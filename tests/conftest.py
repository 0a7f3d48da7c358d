import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from inkwell.session import local_session

    session = local_session(4, 4, "4g", "tests")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples, its columns in the order given."""

    def collect(df, *columns):
        return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)

    return collect
