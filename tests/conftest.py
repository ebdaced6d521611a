import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from caseflow.session import build_session  # noqa: E402
from hand_rows import business_steps, numbered_steps  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def steps(spark):
    """The hand-written rows with numbered step names."""
    return numbered_steps(spark)


@pytest.fixture(scope="session")
def flow_steps(spark):
    """The same rows with business step names."""
    return business_steps(spark)
