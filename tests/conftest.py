import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from eventloom.session import local_session

    return local_session("*")


@pytest.fixture(scope="session")
def tables(spark):
    from eventloom.plans.proxies import Tables

    return Tables(spark, SMALL)
