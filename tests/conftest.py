import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="4g", spark__log__level="ERROR",
                            spark__sql__autoBroadcastJoinThreshold="10485760")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tidemark.plans.fixtures import Tables
    return Tables(spark, SMALL)


def rows(df, *order):
    return sorted((tuple(r) for r in df.select(*(order or df.columns)).collect()), key=repr)


def ts(text):
    return dt.datetime.fromisoformat(text)
