from __future__ import annotations

import datetime as dt
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from panelcast.session import drop_staged, local_session  # noqa: E402

FIRST_FRIDAY = dt.date(2015, 1, 2)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "panelcast-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def week():
    """Date of a week number."""
    return lambda i: FIRST_FRIDAY + dt.timedelta(days=7 * i)


@pytest.fixture(scope="session")
def panel(spark, week):
    """Panel from {(store, dept): {week: sales}}."""

    def make(series, flags=()):
        rows = [
            (s, d, week(i), None if y is None else float(y), i in flags)
            for (s, d), values in series.items()
            for i, y in (values.items() if isinstance(values, dict) else enumerate(values))
        ]
        return spark.createDataFrame(
            rows, "store int, dept string, date date, weekly_sales double, is_holiday boolean"
        )

    return make
