"""Positions over whole tables, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.sources.staged import written


def with_position(df: DataFrame, *order: Column | str, name: str = "position", first: int = 1) -> DataFrame:
    """``df`` with the place of each row in ``order`` (whose columns should leave no ties), from ``first``.

    Rows are dealt out by ranges of the order, each partition is sorted and written; the partitions' row counts, one number
    each, are added up on the driver. So no task holds more than a range.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    d = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    part = F.shiftrightunsigned("_at", 33)
    sizes = {r["part"]: r["n"] for r in d.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], first
    for p in range(max(sizes, default=-1) + 1):
        before.append((p, total))
        total += sizes.get(p, 0)
    starts = spark.createDataFrame(before, "_part long, _start long")
    placed = d.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row a partition
    return placed.withColumn(name, F.col("_start") + F.col("_at") - F.shiftleft("_part", 33)).drop("_part", "_at", "_start")
