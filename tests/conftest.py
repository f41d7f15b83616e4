from __future__ import annotations

import pytest

from tests.compare import spark_session


@pytest.fixture(scope="session")
def spark():
    return spark_session(4)
