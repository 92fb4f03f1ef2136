import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from trackloom.plans.ship import ship

    ship(s)
    yield s
    s.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def two_way_lattice(spark):
    """The lattice of the test views with both directions open everywhere."""
    from pyspark.sql import functions as F

    from trackloom.plans.views import link_view

    big = lambda c: F.col(c).cast("bigint").alias(c)
    there = link_view(spark).select(F.col("link_id").cast("bigint").alias("link"), big("from_node"), big("to_node"), "x1", "y1", "x2", "y2")
    back = there.select((F.col("link") + 10_000).alias("link"), F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return there.unionByName(back)
