from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from verdanta.session import session

    folder = tmp_path_factory.mktemp("checkpoints")
    s = session("local[8]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g", spark__checkpoint__dir=f"file://{folder}", spark__sql__warehouse__dir=f"file://{tmp_path_factory.mktemp('warehouse')}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
