import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkjourney.session import get_spark
    ck = tempfile.mkdtemp(prefix="sj-ck-", dir="/tmp")
    s = get_spark("local[*]", 8, extra={"spark.checkpoint.dir": ck})
    yield s
    s.stop()


def rows(df, *cols):
    """Collect to a list of tuples (sorted) for easy comparison."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
