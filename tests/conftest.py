import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tablewarden import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tablewarden-tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tablewarden-tests-"),
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def scratch(spark, tmp_path):
    return str(tmp_path)


@pytest.fixture(scope="session")
def docs(spark):
    """JSON texts as schema-less documents."""
    from pyspark.sql import functions as F

    def make(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        return df.select(F.try_parse_json("text").alias("doc"))

    return make
