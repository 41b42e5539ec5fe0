import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scorelake.session import build_session

    session = build_session("local[8]", spark_sql_shuffle_partitions="4", spark_driver_memory="8g", spark_ui_enabled="false",
                            spark_ui_showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()
