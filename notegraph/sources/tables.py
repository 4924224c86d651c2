"""Parquet tables of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table up to which its rows are dealt out anew when it has fewer files than there are cores.
SMALL_TABLE = 256 << 20


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` below `root`; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over all cores, for work on each row that costs more than moving it.

    A small file is one row group and would be read, and worked on, by one task. Larger tables have
    row groups enough and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size <= SMALL_TABLE and len(df.inputFiles()) < cores else df
