import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from studyframe.session import build_session
    session = build_session(**{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Lower the hot-group limit so that small groups take the split routes."""
    from studyframe.operators.grouping import HOT_ROWS_CONF
    spark.conf.set(HOT_ROWS_CONF, "20")
    yield
    spark.conf.unset(HOT_ROWS_CONF)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def close(a, b, tol=1e-9):
    assert len(a) == len(b)
    for p, q in zip(a, b):
        for x, y in zip(p, q):
            if isinstance(x, float) and isinstance(y, float):
                assert abs(x - y) <= tol * max(1.0, abs(y)), (p, q)
            else:
                assert x == y, (p, q)
