import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from plumbline.session import local_session  # noqa: E402
from plumbline.sources.tables import Tables  # noqa: E402

DATA = os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "plumbline-tests")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plumbline-test-"))
    return session


@pytest.fixture(scope="session")
def root():
    return DATA


@pytest.fixture(scope="session")
def t(spark, root):
    return Tables(spark, root)


def rows(df, *columns):
    """Sorted tuples of the named columns."""
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
