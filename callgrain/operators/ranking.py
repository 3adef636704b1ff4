"""Places of rows within large groups, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place_in_group(df: DataFrame, keys: list[str], order: str, slice_of: Column, name: str = "place") -> DataFrame:
    """df with the place of each row in its group by `order`, counted from 1.

    slice_of must rise with `order`. Rows are numbered within slices, whose sizes are added up by group: the sums run
    over slices, of which there are few per group. Null keys form a group of their own.
    """
    sliced = df.withColumn("_slice", slice_of)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order))
    same = F.col("_slice").eqNullSafe(F.col("_s"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = sliced.withColumn("_inside", inside).join(sizes, same)
    return placed.withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint")).select(*df.columns, name)


def seeded_order(seed: str, key: Column) -> Column:
    """A fixed random order: the hex digest of seed and key."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))


def digest_slice(order: str) -> Column:
    """Slices of a hex digest: 65,536 of about equal size."""
    return F.substring(order, 1, 4)
