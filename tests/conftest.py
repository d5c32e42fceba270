import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from smolt.session import clean_scratch, get_spark
    s = get_spark("local[4]", shuffle_partitions=8,
                  extra={"spark.driver.memory": "4g",
                         "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield s
    clean_scratch(s)
    s.stop()
