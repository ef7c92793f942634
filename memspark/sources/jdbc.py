"""A relational store over JDBC: its tables as DataFrames, read in parallel; ranking stays in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parallel reads of a table.
PARTS = 16


def read(spark: SparkSession, url: str, table: str, split: str | None = None, low: int = 0, high: int = 0, parts: int = PARTS, **options: str) -> DataFrame:
    """A table; with a numeric column to split by, from low to high, in as many reads as there are parts.

    Filters and column choices on the result are pushed to the database.
    """
    how = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split:
        how = how.option("partitionColumn", split).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts))
    return how.load()


def write(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """rows with vectors that a database shows as text, [1,2,3], as arrays named vec."""
    numbers = F.split(F.regexp_replace(F.col(column), r"[\[\]\s]", ""), ",")
    return rows.withColumn("vec", F.when(F.length(column) > 2, F.transform(numbers, lambda x: x.cast("double")))).drop(column)
