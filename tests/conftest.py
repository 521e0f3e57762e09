import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from fieldloom.session import build_session

    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one expression over a list of single values."""
    def run(make, values, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
        return [r[1] for r in sorted(df.select("n", make(F.col("v")).alias("r")).collect())]

    return run
