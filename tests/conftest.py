import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from arcloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__default__parallelism="2",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def edge_links(spark):
    """A point, an empty link, an equal pair, self-references, a gap at 7 and 8."""
    from arcloom.schema import LINK

    rows = [(1, 1, 1), (2, 0, 0), (3, 1, 2), (4, 1, 2), (5, 5, 1), (6, 1, 6), (9, 9, 9)]
    return spark.createDataFrame(rows, LINK)
