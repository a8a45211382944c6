import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lantern.session import build_session, checkpoint_dir
    s = build_session("local[4]", 4)
    checkpoint_dir(s)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as plain tuples of the given columns (all if none)."""
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.collect()]
