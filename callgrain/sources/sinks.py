"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for reports: results of bounded size only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with nested structs."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended to a log of JSON lines; a batch is there as a whole or not at all."""
    df.write.mode("append").json(path)


def write_folders(df: DataFrame, path: str) -> None:
    """Rows in folders by split and class."""
    df.write.mode("overwrite").partitionBy("split", "true_class").parquet(path)


def rewrite(df: DataFrame, text: str, old: str, new: str, path: str) -> None:
    """Rows with a literal replaced, in a new place; the input stays."""
    df.withColumn(text, F.replace(text, F.lit(old), F.lit(new))).write.mode("overwrite").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """The table at a path replaced as a whole: written beside it, then renamed, so that readers see the old or the new."""
    spark = df.sparkSession
    new = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").parquet(new)
    jvm = spark.sparkContext._jvm
    at, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at, True)
    if not fs.rename(fresh, at):
        raise OSError(f"{new} can't be renamed")


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions (gold, pred and what names a row) as a table by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
