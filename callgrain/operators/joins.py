"""Joins that check what they assume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_once(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right; the query fails if a key stands twice on either side. Null keys match nothing."""
    cols = [c for c in right.columns if c != key]
    one = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min_by(F.struct(*cols), F.lit(0)).alias("_r"))
    one = one.where(_single(key)).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    seen = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return left.join(seen, key, "left").where(F.when(F.col("_n").isNull(), True).otherwise(_single(key))).drop("_n").join(one, key, "left")


def _single(key: str):
    return F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"{key} isn't unique: "), F.col(key).cast("string"))).isNull())


def checked_inner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join; the query fails if a row of left finds no partner."""
    there = right.select(key).distinct().withColumn("_there", F.lit(True))
    bad = F.raise_error(F.concat(F.lit(f"no partner for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).isNull()
    return left.join(there, key, "left").where(F.when(F.col("_there"), True).otherwise(bad)).drop("_there").join(right, key)


def by_path(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(source, path) of wanted files (source) among files (path, relative to their root): as an absolute path, else
    relative, else by name alone, of several the first by path. Files that aren't found have a null path."""
    base = lambda c: F.regexp_extract(c, r"([^/]+)/*$", 1)
    s = wanted.select(F.trim("source").alias("source")).distinct()
    same = files.select("path", F.lit(True).alias("_same"))
    name = files.groupBy(base(F.col("path")).alias("_name")).agg(F.min("path").alias("_first"))
    j = s.join(same, F.col("source") == F.col("path"), "left").withColumn("_name", base(F.col("source"))).join(name, "_name", "left")
    return j.select("source", F.when(F.col("_same"), F.col("path")).when(~F.col("source").startswith("/"), F.col("_first")).alias("path"))
