import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    # Small Arrow batches, so that groups and runs stretch over several.
    session = local_session(int(os.environ.get("TEST_CPUS", "8")), 4, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "7"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
