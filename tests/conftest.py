import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from routeboard.plans.session import RECOMMENDED_CONF
    from routeboard.sources.storage import checkpoint_root

    builder = (
        SparkSession.builder.master("local[*]").appName("routeboard-tests")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_root(session)   # uses spark.checkpoint.dir when set, a temp dir otherwise
    yield session
    session.stop()
