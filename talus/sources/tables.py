"""Table scans over a directory of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.session import ship_package


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one table. Zone-less timestamps mean UTC; they become TIMESTAMP under the UTC session zone."""
    ship_package(spark)
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df
