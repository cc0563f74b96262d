import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowweir.schema import PACKET_SCHEMA  # noqa: E402
from flowweir.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def packet(
    i,
    seconds,
    src="10.0.0.1",
    dst="10.0.0.2",
    sport=1000,
    dport=80,
    proto=6,
    flags=0,
    payload=0,
    capture="c",
    dataofs=5,
):
    tcp = proto == 6
    ports = proto in (6, 17)
    return (
        capture,
        i,
        round(seconds * 1_000_000),
        src,
        dst,
        proto,
        5,
        sport if ports else None,
        dport if ports else None,
        dataofs if tcp else None,
        flags if tcp else None,
        payload,
        payload + 34 + (dataofs * 4 if tcp else 8),
    )


@pytest.fixture(scope="session")
def packets(spark):
    return lambda rows: spark.createDataFrame(rows, PACKET_SCHEMA)
