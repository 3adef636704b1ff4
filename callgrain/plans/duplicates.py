"""Exact and normalised duplicates, and what leaks between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions import text as T
from callgrain.plans.registry import query
from callgrain.sources.tables import table

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^ \t\n\r\f]+|www\.[^ \t\n\r\f]+', '<URL>', 'g'), '\+?[0-9][0-9 \t\n\r\f\-()]{7,}[0-9]', '<PHONE>', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ')"


def groups(docs: DataFrame, key: Column) -> DataFrame:
    """Groups of two or more documents with the same key: size, members and classes in order."""
    keyed = docs.where(F.col("text").isNotNull()).select("rec_id", "true_class", T.digest(key).alias("hash"))
    g = keyed.groupBy("hash").agg(F.count("*").alias("n"), F.min("rec_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("true_class")), "|").alias("classes"))
    return g.where("n > 1")


def _groups_sql(key: str) -> str:
    return f"SELECT sha256({key}) AS hash, count(*) AS n, min(rec_id) AS first_id, coalesce(array_to_string(list_sort(list_distinct(list(true_class) FILTER (WHERE true_class IS NOT NULL))), '|'), '') AS classes FROM count_analysis WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


@query(_groups_sql("text"))
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return groups(table(spark, d, "count_analysis"), F.col("text"))


@query(_groups_sql(NORM))
def normalised_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return groups(table(spark, d, "count_analysis"), T.mask_contacts(F.col("text")))


@query()
def template_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Groups by template text; look-behind keeps it from RE2, so the rule is held by unit tests."""
    return groups(table(spark, d, "count_analysis"), T.template_text(F.col("text")))


@query(f"WITH e AS ({_groups_sql('text')}), m AS ({_groups_sql(NORM)}) SELECT 'exact' AS kind, count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS members, coalesce(sum(n - 1), 0)::BIGINT AS extras, coalesce(max(n), 0)::BIGINT AS largest, count_if(contains(classes, '|'))::BIGINT AS cross_class FROM e UNION ALL SELECT 'normalised', count(*), coalesce(sum(n), 0)::BIGINT, coalesce(sum(n - 1), 0)::BIGINT, coalesce(max(n), 0)::BIGINT, count_if(contains(classes, '|'))::BIGINT FROM m")
def duplicate_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "count_analysis")
    both = groups(docs, F.col("text")).withColumn("kind", F.lit("exact")).unionByName(groups(docs, T.mask_contacts(F.col("text"))).withColumn("kind", F.lit("normalised")))
    cell = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return both.groupBy("kind").agg(F.count("*").alias("n_groups"), cell(F.sum("n")).alias("members"), cell(F.sum(F.col("n") - 1)).alias("extras"), cell(F.max("n")).alias("largest"), F.count_if(F.col("classes").contains("|")).alias("cross_class"))


@query(f"SELECT sha256({NORM}) AS hash, count(*) AS n, count(DISTINCT split) AS n_splits, array_to_string(list_sort(list_distinct(list(split))), '|') AS splits FROM count_analysis WHERE text IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "count_analysis").where("text IS NOT NULL AND split IS NOT NULL").select("split", T.digest(T.mask_contacts(F.col("text"))).alias("hash"))
    # the splits of a group are few, so the set is bounded and is built before the shuffle
    g = keyed.groupBy("hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("split")).alias("s"))
    return g.where(F.size("s") > 1).select("hash", "n", F.size("s").cast("bigint").alias("n_splits"), F.array_join("s", "|").alias("splits"))


@query("WITH tr AS (SELECT text, max(rec_id) AS train_id FROM count_analysis WHERE split = 'train' AND text IS NOT NULL GROUP BY text) SELECT t.rec_id AS test_id, train_id FROM count_analysis t JOIN tr USING (text) WHERE t.split = 'test'")
def leak_exact_last(spark: SparkSession, d: str) -> DataFrame:
    """Each test row with the last train row of the same text, at most one."""
    docs = table(spark, d, "count_analysis").where("text IS NOT NULL").select("rec_id", "split", "text", T.digest(F.col("text")).alias("h"))
    train = docs.where("split = 'train'").groupBy("h").agg(F.max("rec_id").alias("train_id"))
    return docs.where("split = 'test'").join(train, "h").select(F.col("rec_id").alias("test_id"), "train_id")


@query(f"WITH k AS (SELECT rec_id, split, {NORM} AS k FROM count_analysis WHERE text IS NOT NULL), t AS (SELECT k, count(*) AS n_train, min(rec_id) AS train_id FROM k WHERE split = 'train' AND k <> '' GROUP BY k) SELECT rec_id AS test_id, train_id, n_train FROM k JOIN t USING (k) WHERE split = 'test'")
def leak_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Each test row whose normalised text stands in train: with the first such train row and how many there are.

    A text that a third of the rows hold would make pairs without number; a row per test row loses none of them, since
    all train rows of one text are alike. Blank ones are left out.
    """
    docs = table(spark, d, "count_analysis").where("text IS NOT NULL").select("rec_id", "split", T.mask_contacts(F.col("text")).alias("k")).where("k <> ''").select("rec_id", "split", T.digest(F.col("k")).alias("h"))
    train = docs.where("split = 'train'").groupBy("h").agg(F.count("*").alias("n_train"), F.min("rec_id").alias("train_id"))
    return docs.where("split = 'test'").join(train, "h").select(F.col("rec_id").alias("test_id"), "train_id", "n_train")


@query("SELECT filepath, count(*) AS loads, epoch(min(loaded_at))::BIGINT AS first_load, epoch(max(loaded_at))::BIGINT AS last_load, count(DISTINCT text) AS texts FROM count_analysis GROUP BY filepath HAVING count(*) > 1")
def repeated_loads(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "count_analysis")
    return t.groupBy("filepath").agg(F.count("*").alias("loads"), F.unix_timestamp(F.min("loaded_at")).alias("first_load"), F.unix_timestamp(F.max("loaded_at")).alias("last_load"), F.count_distinct(T.digest(F.col("text"))).alias("texts")).where("loads > 1")


@query("SELECT rec_id, CASE WHEN n = 1 THEN filename ELSE regexp_replace(filename, '\\.txt$', '') || '_' || n || '.txt' END AS target FROM (SELECT rec_id, filename, row_number() OVER (PARTITION BY split, true_class, filename ORDER BY rec_id) AS n FROM count_analysis WHERE filename IS NOT NULL)")
def copy_targets(spark: SparkSession, d: str) -> DataFrame:
    """Names of files copied into class folders; a name that is taken gets a number.

    One default name holds many rows: places are counted first within slices of rec_id, then the slices are added up,
    so that no single task sorts a whole name.
    """
    from pyspark.sql import Window

    key = ["split", "true_class", "filename"]
    t = table(spark, d, "count_analysis").where("filename IS NOT NULL").select("rec_id", *key)
    t = t.withColumn("slice", F.shiftright("rec_id", 10))
    counts = t.groupBy(*key, "slice").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy(*key, "slice").orderBy("rec_id"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "slice"]]
    both = t.withColumn("place", place).alias("t").join(before.alias("b"), same)
    n = (F.col("place") + F.col("before")).cast("bigint")
    stem = F.regexp_replace("t.filename", r"\.txt$", "")
    return both.select("t.rec_id", F.when(n == 1, F.col("t.filename")).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), F.lit(".txt"))).alias("target"))


@query(f"SELECT sha256({NORM}) AS hash, rec_id, n FROM (SELECT *, count(*) OVER (PARTITION BY {NORM}) AS n FROM count_analysis WHERE text IS NOT NULL) WHERE n > 1")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    """Each row of a group of equal normalised texts, with the size of its group."""
    keyed = table(spark, d, "count_analysis").where("text IS NOT NULL").select("rec_id", T.digest(T.mask_contacts(F.col("text"))).alias("hash"))
    return keyed.join(keyed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "hash").select("hash", "rec_id", "n")
