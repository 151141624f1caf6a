import os
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from schedlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests",
        f"local[{os.environ.get('TEST_CPUS', '8')}]",
        shuffle_partitions=4,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.legacy.javaCharsets": "true"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF
