import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from linkfold.session import local_session

    session = local_session("8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Lines frame from ``{(dataset, file): text}``."""

    def make(files: dict):
        rows = [
            (dataset, name, i, raw)
            for (dataset, name), body in files.items()
            for i, raw in enumerate(body.split("\n"), start=1)
        ]
        return spark.createDataFrame(rows, "dataset_id string, file_name string, line_no bigint, raw string")

    return make
