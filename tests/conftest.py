from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from terraloom.session import local_session

    s = local_session(4, shuffle_partitions=4, memory="4g", spark__sql__codegen__cache__maxEntries="200")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)
