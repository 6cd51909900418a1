import os

import pytest

from litgraph.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master=f"local[{os.environ.get('TEST_CPUS', '4')}]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
