import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tillrec.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="tillrec-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples (small test frames only)."""
    return [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
