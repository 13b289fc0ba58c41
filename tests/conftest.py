import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture()
def many_ranges(monkeypatch):
    """Forces every order statistic through the two-level path with a handful of rows per range."""
    from panelwright.operators import ordered

    monkeypatch.setattr(ordered.range_count, "__defaults__", (7,))
