"""Row numbers that survive a group holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut_lineage


def group_rank(df: DataFrame, groups: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """``row_number`` per group where no single task has to hold a whole group.

    Rows are range-partitioned on group and order, numbered inside each slice, and shifted by
    the sizes of the earlier slices of the same group.  A hot group spreads over many slices.
    The sorted rows are written once, because both passes must see the same slice borders.
    """
    columns = df.columns
    keys = [F.col(g) for g in groups] + [F.col(o) if isinstance(o, str) else o for o in order]
    sliced = cut_lineage(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()))
    sizes = sliced.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col("_slice").alias("_slice_of"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"),
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy(*keys[len(groups):])
    numbered = sliced.withColumn("_in", F.row_number().over(inside))
    match = F.col("_slice") == F.col("_slice_of")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = numbered.join(shifts, match)
    return joined.select(*columns, (F.col("_in") + F.col("_shift")).alias(name))


def top_per_group(df: DataFrame, groups: list[str], order: list[Column | str], limit: int, name: str) -> DataFrame:
    """First ``limit`` rows of each group; Spark prunes before the shuffle, so hot groups stay small."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
