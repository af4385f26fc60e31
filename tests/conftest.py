import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadkin import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session.build(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield spark


@pytest.fixture(scope="session")
def samples(spark):
    from leadkin.sources.tables import read_table

    here = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
    return tuple(read_table(spark, f"{here}/sample_{side}.csv") for side in ("customers", "potentials"))
