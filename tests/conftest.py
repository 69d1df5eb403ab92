import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seamline import schema  # noqa: E402
from seamline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """Files table from {path: text}; the first directory is the module, the version is v1."""
    def make(texts):
        rows = []
        for path, content in texts.items():
            directory, name = path.rsplit("/", 1)
            ext = "." + name.rsplit(".", 1)[1] if "." in name else ""
            rows.append((path.split("/")[0], "v1", directory, path, name, ext, content))
        return spark.createDataFrame(rows, schema.FILES_SCHEMA)
    return make
