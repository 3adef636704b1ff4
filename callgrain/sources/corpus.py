"""Readers of files: class folders, seed lines, logs, checkpoints; and columns found by their usual names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def class_folders(spark: SparkSession, root: str, split: str | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(filename, filepath, true_class, split, text) of <root>/<class>/**/*.txt; bytes that aren't UTF-8 are replaced.

    Files without a byte have no row: Spark's file sources pass them over; blank ones have one. With classes (slug), files in other folders are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").load(root)
    path = F.col("path")
    base = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace(F.url_decode(path), "^file:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    rows = raw.select(F.regexp_extract(rel, "([^/]+)$", 1).alias("filename"), rel.alias("filepath"), F.split(rel, "/")[0].alias("true_class"), F.lit(split).alias("split"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return rows if classes is None else rows.join(F.broadcast(classes.select(F.col("slug").alias("true_class"))), "true_class", "left_semi").select(*rows.columns)


def missing_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes without any file."""
    return classes.select("slug").join(rows.select(F.col("true_class").alias("slug")).distinct(), "slug", "left_anti")


def seed_lines(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(label, text) of lines `label<TAB>text` with the given label; the text may hold tabs."""
    p = F.split("value", "\t", 2)
    return spark.read.text(path).select(p[0].alias("label"), F.get(p, F.lit(1)).alias("text")).where(F.col("label") == label)


def record_log(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """The last record of each key of a log of JSON lines; lines that can't be read are skipped."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    rows = rows.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull()).drop("_corrupt_record")
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def json_map(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """(key, label) of a file that holds one JSON object of labels; labels outside `allowed` are dropped."""
    m = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "label"))
    return m.where(F.col("label").isin(allowed))


def resolve_column(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """The first candidate that is a column, whatever its case; an error if one is required and none is there."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[c.lower()] for c in candidates if c.lower() in have), None)
    if found is None and required:
        raise ValueError(f"none of {candidates} among {df.columns}")
    return found


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, read by a schema; a row that doesn't fit it fails the query."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)


def labelled_corpus(rows: DataFrame, classes: DataFrame, keep_blank: bool = True, most_chars: int | None = None) -> DataFrame:
    """Rows of `class_folders` with the number of their class (classes: slug, class_no) and the length of their text;
    blank ones left out, and texts trimmed to a first part, on demand."""
    own = rows.join(F.broadcast(classes.select(F.col("slug").alias("true_class"), "class_no")), "true_class")
    if not keep_blank:
        own = own.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    if most_chars is not None:
        own = own.withColumn("text", F.substring(F.trim("text"), 1, most_chars))
    return own.withColumn("char_len", F.length("text"))


def checked_corpus(rows: DataFrame, classes: DataFrame, required: bool = False) -> DataFrame:
    """The rows themselves, once it is known that there are some and, if required, some of every class."""
    lacking = [r.slug for r in missing_classes(rows, classes).orderBy("slug").collect()]  # classes are few
    if len(lacking) == classes.select("slug").distinct().count():
        raise ValueError("no file of any class")
    if lacking:
        if required:
            raise ValueError(f"no file of {', '.join(lacking)}")
        import warnings

        warnings.warn(f"no file of {', '.join(lacking)}", stacklevel=2)
    return rows


def input_manifest(spark: SparkSession, root: str, expected: list[str]) -> DataFrame:
    """(name, found) of the inputs that a report expects below a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(n, bool(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}")))) for n in expected]
    return spark.createDataFrame(found, "name string, found boolean")


def log_or_array(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """As `record_log`, also for a file that holds one JSON array."""
    lines = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if lines and lines[0].value.lstrip().startswith("["):
        rows = spark.read.schema(schema).option("multiLine", True).json(path).where(F.col(key).isNotNull())
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return record_log(spark, path, schema, key, order)
