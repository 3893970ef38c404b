import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from repsight.plans.session import local_session
    # the configured spark.checkpoint.dir is used when there is one; otherwise local_session
    # sets a temporary folder (local mode only)
    s = local_session(cores=4, shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck001():
    from compare import duck
    return duck(SF001)


@pytest.fixture(scope="session")
def fp():
    from repsight.params import fixture_params
    return fixture_params()


@pytest.fixture(scope="session")
def star001(spark, fp, tmp_path_factory):
    """The star of the test tables, written once to a folder of the test run."""
    from repsight.sources.fixtures import materialize_star
    return materialize_star(spark, SF001, fp, str(tmp_path_factory.mktemp("star") / "star"))
