import os
import sys

import pytest

TESTS = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(TESTS), TESTS]

from helpers import LOG_DDL, at  # noqa: E402
from vigilog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            # Small test frames should still be spread over several tasks.
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_logs(spark):
    """Log rows from dicts with any of the columns."""
    names = [part.split()[0] for part in LOG_DDL.split(", ")]

    def make(rows):
        defaults = {"timestamp": at(), "service_name": "api-gateway", "log_level": "INFO"}
        full = [{**defaults, "event_id": f"e{i:04d}", **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], LOG_DDL)

    return make
