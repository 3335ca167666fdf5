import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from echolot.runtime import session

    spark = session(4, "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__driver__memory="4g")
    yield spark
    spark.stop()
