import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docketspark.session import build

    session = build(
        "tests",
        spark__master="local[4]",
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('checkpoints')}",
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
