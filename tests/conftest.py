from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    conf = {
        "spark.checkpoint.dir": folder,
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.showConsoleProgress": "false",
    }
    session = local_session(8, "tests", **conf)
    yield session
    session.stop()
