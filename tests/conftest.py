import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from echofold.plans.session import local_session

    session = local_session("tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def data():
    """The smallest of the driver's tables."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder
