import pytest
from pyspark.sql import SparkSession

from boxtrail.runtime import configure


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("boxtrail-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    )
    yield configure(session)
    session.stop()
