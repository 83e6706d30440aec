import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from statloom.session import local_session

    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("no test data here")
    return SF
