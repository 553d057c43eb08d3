"""Measured queries."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from loomtext.plans.observed import MEASURED, measured, totals


def test_stages_of_each_query_alone(spark, tmp_path):
    spark.range(1000).withColumn("k", F.col("id") % 7).coalesce(2).write.parquet(f"file://{tmp_path}/t")
    read = lambda: spark.read.parquet(f"file://{tmp_path}/t")
    table = measured(spark, {"all": read, "grouped": lambda: read().groupBy("k").count(), "none": lambda: read().filter("id < 0"), "local": lambda: spark.createDataFrame([(1,)], "x int").filter("false")})
    assert table.columns == [c.split()[0] for c in MEASURED.split(", ")]
    got = {r["query"]: r for r in totals(table).collect()}
    assert {q: r["rows_out"] for q, r in got.items()} == {"all": 1000, "grouped": 7, "none": 0, "local": 0}
    assert got["all"]["rows_read"] == 1000 and got["all"]["shuffle_bytes_written"] == 0 and got["all"]["bytes_read"] > 0
    assert got["grouped"]["stages"] >= 2 and got["grouped"]["rows_read"] == 1000 and got["grouped"]["shuffle_bytes_read"] == got["grouped"]["shuffle_bytes_written"] > 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_skipped_stages_that_are_forgotten(tmp_path):
    """An application that has run more stages than Spark keeps forgets skipped ones first."""
    code = """
from pyspark.sql import SparkSession, functions as F
from loomtext.plans.observed import measured, totals
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.ui.retainedStages", "100").getOrCreate()
for i in range(120):
    spark.range(10).count()
spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
made = {"grouped": lambda: spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count().groupBy("count").agg(F.count("*").alias("n")).repartition(2, "n")}
for i in range(5):
    got = totals(measured(spark, made)).first()
    assert got["rows_out"] == 2 and got["stages"] == 5, got
print("measured")
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("measured"), out.stderr[-2000:]
