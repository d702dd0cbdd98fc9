import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))

from strandframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8, **{"spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="warehouse-"), "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s
