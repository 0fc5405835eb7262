import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from vitrina.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def ctx(spark):
    from vitrina.sources.bindings import ShopTables
    return ShopTables(spark, SF_SMALL)
