from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sonotable.session import get_session

    s = get_session(extra={"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_new():
    return tempfile.mkdtemp(prefix="sonotable-test-")


def one_col(spark, values, name="x", type_="string"):
    from pyspark.sql import types as T

    t = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}[type_]
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, t)]))
