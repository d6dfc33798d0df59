import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from sitelens.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g",
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="sitelens-ckpt-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from sitelens.session import drop_tables
    drop_tables(s)
    s.stop()


def one_col(spark, values, name="v"):
    """DataFrame with a single nullable string column and a row index."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField(name, T.StringType())])
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)
