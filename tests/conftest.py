import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from granary.session import session

    root = tmp_path_factory.mktemp("spark")
    out = session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(root / "warehouse"), "spark.checkpoint.dir": f"file://{root}/checkpoints",
        },
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
