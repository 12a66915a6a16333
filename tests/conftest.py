import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))



@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusloom.session import session

    s = session("tests", "local[8]", **{"spark_sql_shuffle_partitions": "8", "spark_ui_enabled": "false", "spark_driver_memory": "4g", "spark_checkpoint_dir": f"file://{tmp_path_factory.mktemp('checkpoints')}"})
    s.sparkContext.setLogLevel("ERROR")
    return s
