import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridcast import get_session

    s = get_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Blocks of eight steps, so that every fixture crosses many edges."""
    from gridcast.functions import blocks

    monkeypatch.setattr(blocks, "BLOCK_STEPS", 8)
