import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nocturne.runtime import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 4)


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(autouse=True)
def no_leftover_cache(spark):
    yield
    spark.catalog.clearCache()
