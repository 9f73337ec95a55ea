"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerlens.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(8, **{"spark.sql.shuffle.partitions": "4"}))
    yield session
    session.stop()
