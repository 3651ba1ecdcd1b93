import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from frameloom.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session("4", 4, **{"spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": str(folder / "warehouse")})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
