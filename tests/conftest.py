import json
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from sluicebox.session import configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("sluicebox tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def write_lines(tmp_path):
    """Write records, or raw text, as JSON lines below the test's folder."""

    def write(name, records):
        path = Path(tmp_path, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = [record if isinstance(record, str) else json.dumps(record) for record in records]
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    return write
