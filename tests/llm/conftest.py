"""A scratch folder for operators that write tables."""

from __future__ import annotations

import pytest


@pytest.fixture
def scratch(spark):
    from ledgerlens.llm.shared import Scratch

    held = Scratch(spark, "test")
    yield held
    held.drop()
