import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import local_session

    warehouse = tempfile.mkdtemp(prefix="ledgerlens-test-warehouse-")
    s = local_session(cpus=4, shuffle_partitions=4, app="ledgerlens-tests",
                      extra={"spark.sql.warehouse.dir": warehouse})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-test-ckpt-"))
    yield s


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="ledgerlens-test-")
