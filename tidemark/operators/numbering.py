"""Numbers within groups, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.sources.files import scratch

#: Groups of more rows are numbered in cells.
HOT = 200_000


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str, hot: int = HOT) -> DataFrame:
    """Numbers the rows of each group from 1 in an order.

    Groups up to ``hot`` rows are numbered by a window. Larger ones are dealt to ordered cells
    by ranges of group and order, and written, so that a lost task cannot deal them anew. Rows
    are numbered in their cell and continue after the rows of earlier cells of their group, so
    a task holds one cell. Both ways give the same numbers; rows that tie in the whole order
    are numbered in any order. Group columns may be null, and nulls are one group.
    """
    spark = df.sparkSession
    window = Window.partitionBy(*group)
    n = F.row_number().over(window.orderBy(*order)).cast("long").alias(name)
    large = df.groupBy(*group).count().where(F.col("count") > hot).drop("count")
    if large.isEmpty():
        return df.select("*", n)
    is_large = [F.col(f"d.{g}").eqNullSafe(F.col(f"l.{g}")) for g in group]
    match = is_large[0]
    for c in is_large[1:]:
        match &= c
    small = df.alias("d").join(large.alias("l"), match, "left_anti")
    rows = df.alias("d").join(large.alias("l"), match, "left_semi")
    path = scratch(spark, "cells")
    rows.repartitionByRange(*group, *order).withColumn("__cell", F.spark_partition_id()).write.parquet(path)
    cells = spark.read.schema(StructType([*rows.schema.fields, StructField("__cell", IntegerType())])).parquet(path)
    sizes = cells.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__cell").alias("__c"), before.alias("__before"))
    here = cells.withColumn("__k", F.row_number().over(Window.partitionBy(*group, "__cell").orderBy(*order)))
    same = F.col("__cell") == F.col("__c")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = here.join(starts, same).select(*df.columns, (F.col("__before") + F.col("__k")).alias(name))
    return small.select("*", n).unionByName(out)
