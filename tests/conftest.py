import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitalgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("vitalgrid-tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def rows(spark):
    """Rows of a frame as dicts, in a stable order."""
    def get(df, *order):
        out = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(out, key=lambda r: tuple(str(r[o]) for o in order)) if order else out
    return get
