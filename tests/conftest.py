from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rasterloom.session import session

    folder = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]",
        4,
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=f"file:{folder}/shared",
        spark__sql__warehouse__dir=f"{folder}/warehouse",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
