import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_rows import COLUMNS, EDGE_ROWS  # noqa: E402


@pytest.fixture
def edge_docs(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else 0, *["x"] * 13) for r in EDGE_ROWS], COLUMNS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
