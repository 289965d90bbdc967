import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from textloom.session import DEFAULT_CONF, ensure_checkpoint_dir

    b = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # only when the session names no checkpoint folder (local tests)
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="textloom-test-ckpt-"))
    yield s
