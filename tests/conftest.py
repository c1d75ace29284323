import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from guestlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "guestlens-tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_rows():
    """Three raw reviews: key, rating, month, location, text, branch."""
    return [
        ("1", 5, "2019-4", "Australia", "Great park!", "Disneyland_HongKong"),
        ("2", 3, "2019-5", "Australia", "Lines too long.", "Disneyland_California"),
        ("3", 1, "2019-12", "UK", "Too cold.", "Disneyland_Paris"),
    ]


@pytest.fixture(scope="session")
def raw(spark, raw_rows):
    return spark.createDataFrame(
        raw_rows, "review_uid string, Rating int, Year_Month string, Reviewer_Location string, Review_Text string, Branch string"
    )
