"""Numbers of rows in an order, without bringing a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import materialize


def numbered(df: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in its group, from 1.

    Rows are dealt out by ranges of the order. A part knows the places within itself; how many rows of the group
    stand in earlier parts is a table of a row for each part and group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, F.col(group), *order).withColumn("_part", F.spark_partition_id())
    within = dealt.withColumn("_within", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    within = materialize(within, "numbered")
    counts = within.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), before.alias("_before"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))
    return within.join(offsets, same).withColumn(name, F.col("_within") + F.col("_before")).drop("_group", "_of", "_part", "_within", "_before")
