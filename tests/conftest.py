from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Connections to the driver's tables by scale factor."""
    import duckdb

    held = {}

    def connect(sf: str):
        if sf not in held:
            c = held[sf] = duckdb.connect()
            for f in os.listdir(f"{DATA}/{sf}"):
                c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{sf}/{f}'")
        return held[sf]

    return connect


def rows_of(frame):
    """Rows as sorted tuples of the columns in name order, floats as they are."""
    names = sorted(frame.columns)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return names, sorted((tuple(r[n] for n in names) for r in frame.to_dict("records")), key=key)
