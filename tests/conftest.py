from __future__ import annotations

import pytest

from quillwork.session import FOLD_ROWS, GROUP_ROWS, build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
        },
    )
    yield session
    session.stop()


@pytest.fixture(params=["whole", "chunked"])
def sizes(request, spark):
    """Run a test with keys that fit a task and with keys that have to be split."""
    if request.param == "chunked":
        spark.conf.set(GROUP_ROWS, "7")
        spark.conf.set(FOLD_ROWS, "5")
    yield request.param
    spark.conf.unset(GROUP_ROWS)
    spark.conf.unset(FOLD_ROWS)
