import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    session = build_session("tests", 4, shuffle_partitions=2)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted plain tuples of a DataFrame, nulls first."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        out = [tuple(r) for r in picked.collect()]
        return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))

    return collect
