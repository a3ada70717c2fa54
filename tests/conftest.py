import os
import sys
from datetime import date
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from segtide.session import build_session  # noqa: E402

ACTIVITY = "user_id bigint, dt date, app bigint, played boolean, spent boolean, coin bigint"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "segtide-tests",
        f"local[{os.environ.get('TEST_CPUS', '8')}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Build an activity table from ``(user, day, app, kind, coin)`` with kind 'play' or 'spend'."""

    def build(rows):
        shaped = [
            (user, date.fromisoformat(day), app, kind == "play", kind == "spend", coin)
            for user, day, app, kind, coin in rows
        ]
        return spark.createDataFrame(shaped, ACTIVITY)

    return build


def tuples(df, *columns):
    """Rows of the chosen columns as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
