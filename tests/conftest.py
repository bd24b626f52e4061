import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from trajens.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="trajens-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as plain tuples, sorted (order-free comparison)."""
    out = [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x) if x is None else x) for x in t))
