"""One local session for all tests."""

from __future__ import annotations

import pytest

from sitewright.session import local, ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local(8, 4, "6g")
    ship(s)
    return s


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
