import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from support import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from errorlab.session import local_session

    s = local_session("*", shuffle_partitions=8, app="errorlab-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from errorlab.plans.fixtures import Fx

    return Fx(spark, SF_SMALL)
