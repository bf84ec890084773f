import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("filmroll-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["small groups and broadcasts", "counting passes and shuffle joins"])
def paths(spark, request):
    """Both ways of every operator that chooses one by measured size."""
    large = request.param.startswith("counting")
    settings = {"spark.filmroll.quantile.smallGroupRows": "0", "spark.filmroll.quantile.windowRows": "40",
                "spark.filmroll.broadcastBytes": "0"} if large else {}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield request.param
    for k in settings:
        spark.conf.unset(k)
