from __future__ import annotations

import pytest

from stridemill.session import build_session, release_staged


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def skewed(spark):
    """Series of very different length: key 0 holds a third of all rows, one key is NULL."""
    rows = [(k, t, None if t % 7 == 3 else float((t * 13 + (k or 5)) % 29)) for k, n in (
        (0, 120), (1, 3), (2, 60), (3, 1), (4, 40), (None, 30), (6, 100)
    ) for t in range(n)]
    order = sorted(rows, key=lambda r: (r[1] * 31 + (r[0] or 0) * 17) % 101)
    return spark.createDataFrame(order, "k INT, t INT, v DOUBLE")
