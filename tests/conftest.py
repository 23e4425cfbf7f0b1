from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def same():
    """Whether two pandas frames hold the same rows, whatever their order."""

    def text(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return repr([text(x) for x in v])
        if v is None or (isinstance(v, float) and v != v):
            return "None"
        return repr(round(float(v), 9)) if isinstance(v, float) or "float" in type(v).__name__ else str(v)

    def check(a, b):
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        rows = lambda x: sorted(tuple(text(v) for v in r) for r in x[columns].itertuples(index=False))
        assert rows(a) == rows(b)

    return check
