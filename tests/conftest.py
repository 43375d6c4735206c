import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pvtide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "pvtide-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    """A fresh scratch folder per test (never reused, never cleared)."""
    return tempfile.mkdtemp(prefix="pvtide-test-")


def T(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


READINGS_DDL = "ss_id int, datetime_GMT timestamp, generation_Wh float"
