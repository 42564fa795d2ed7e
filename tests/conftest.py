import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldline.session import get_session  # noqa: E402
from fieldline.sources.readers import normalise_events  # noqa: E402
from fieldline.schema import event_schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def event(id, player=1, match=1, period="1H", team=10, kind=8, sub="85", name="Pass", sec=0.0, tags=(), at=((50.0, 50.0),)):
    """One raw event; positions are (x, y) pairs."""
    return (
        id, player, match, period, team, kind, sub, name, sec,
        None if tags is None else [(t,) for t in tags],
        None if at is None else [(y, x) for x, y in at],
    )


@pytest.fixture
def make_events(spark):
    def make(*rows):
        return normalise_events(spark.createDataFrame(list(rows), event_schema()))

    return make


def by_key(df, *keys):
    """Collected rows as {key: {column: value}}; a single key is not a tuple."""
    out = {}
    for row in df.collect():
        values = row.asDict()
        key = tuple(values.pop(k) for k in keys)
        key = key[0] if len(keys) == 1 else key
        assert key not in out, f"{key} occurs twice"
        out[key] = values
    return out
