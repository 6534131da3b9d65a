import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tessel.session import build_session

    session = build_session("tests", 4, 4)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
