import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crawlgrain.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "local[4]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dom_of(spark):
    """DOM rows of the given HTML texts, numbered from 1."""
    from crawlgrain.operators.dom import parse_pages

    def build(*htmls):
        rows = [(i, f"http://h/{i}", html) for i, html in enumerate(htmls, 1)]
        return parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))

    return build
