"""Tables that change one partition at a time: a run replaces its own part and leaves the files of the others alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from webloom.session import drop_path


def part_path(path: str, by: str, value: str) -> str:
    """The folder of one partition, for values of letters, digits, ``_``, ``-`` and ``.``."""
    if not value or not all(c.isalnum() or c in "_-." for c in value):
        raise ValueError(f"not a partition name: {value!r}")
    return f"{path.rstrip('/')}/{by}={value}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, with the columns of ``schema`` in order; empty where nothing was stored yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(path)
    return found.select(*spark.createDataFrame([], schema).columns)


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def replace_part(rows: DataFrame, path: str, by: str, value: str) -> None:
    """Put ``rows`` in the place of the partition ``by = value`` of the table at ``path``.

    The rows are computed to the end before anything is touched: a run that fails leaves the table as it was, and a run may
    read the table that it changes. They are written once, into a hidden folder of the table, and counted on the way; that
    folder takes the partition's place when all tasks are through. Running twice gives what running once gives. Rows of
    another partition, or of none, raise. No rows empty the partition.
    """
    spark = rows.sparkSession
    folder = part_path(path, by, value)
    ready = f"{path.rstrip('/')}/.{by}-{uuid.uuid4().hex}"
    seen = Observation()
    counted = rows.observe(seen, F.count("*").alias("n"), F.count_if(~F.col(by).eqNullSafe(F.lit(value))).alias("strange"))
    try:
        counted.drop(by).write.parquet(ready)
        found = seen.get  # nothing, where the plan is known to have no rows
        n, strange = found.get("n", 0), found.get("strange", 0)
        if strange:
            raise ValueError(f"{strange} rows do not belong to {by}={value}")
        drop_path(spark, folder)
        if n:
            _move(spark, ready, folder)
    finally:
        drop_path(spark, ready)
