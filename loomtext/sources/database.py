"""Tables of a relational database, read in parallel by ranges of a numeric key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table through JDBC; filters and columns are pushed to the database. The driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The same tables from Parquet files, by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
