import os
import sys
import tempfile
from pathlib import Path

import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"file://{scratch}/checkpoints")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_rows(spark_rows, sql_rows):
    """Rows of two pandas frames as sorted tuples of comparable values."""
    assert sorted(spark_rows.columns) == sorted(sql_rows.columns)
    names = sorted(spark_rows.columns)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{float(v):.6f}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "iuf" or isinstance(v, int) and not isinstance(v, bool) else str(v)

    def rows(frame):
        return sorted(tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False))

    assert rows(spark_rows) == rows(sql_rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con
