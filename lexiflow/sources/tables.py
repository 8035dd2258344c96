"""Parquet table source with a parallelism floor.

A table written as one file with one row group is scanned by a single task,
and every per-row step before the first shuffle (line splitting, regex
filters, explode) then runs on one core.  A *small* table (under ``SMALL`` bytes) whose scan has
fewer splits than the cluster's default parallelism is hash-partitioned on
its key (deterministic under task retry).  A larger table is never moved for this: its scan is split by
``spark.sql.files.maxPartitionBytes`` and by its row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: estimated bytes up to which a table is dealt anew
SMALL = 1 << 30


def spread(df: DataFrame, key: list[str] | None = None, min_partitions: int | None = None) -> DataFrame:
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= want or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    return df.repartition(want, *key) if key else df.repartition(want)


def read_table(spark: SparkSession, path: str, key: list[str] | None = None,
               min_partitions: int | None = None) -> DataFrame:
    return spread(spark.read.parquet(path), key, min_partitions)
