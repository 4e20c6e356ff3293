import os

import pytest

from cladeframe.session import local_session

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g", "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return s
