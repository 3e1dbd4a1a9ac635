import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from thermogrid.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    release(session)
    session.stop()


START = datetime(2024, 1, 1)
SERIES = "series_id string, ts timestamp, temp double, dew double"


def hours(n, first=START):
    return [first + timedelta(hours=i) for i in range(n)]


@pytest.fixture
def series(spark):
    """Make a series from lists of measures, one per hour; ``skip`` leaves hours out."""

    def make(temp, dew=None, key="a", first=START, skip=()):
        dew = [None if t is None else t - 4.0 for t in temp] if dew is None else dew
        rows = [(key, ts, t, d) for i, (ts, t, d) in enumerate(zip(hours(len(temp), first), temp, dew)) if i not in skip]
        return spark.createDataFrame(rows, SERIES)

    return make


def column(df, name, order="ts"):
    return [row[name] for row in df.orderBy(order).collect()]
