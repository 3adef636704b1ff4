"""Stratified splits and samples, blinded packages and quotas; every draw follows from a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.operators.ranking import digest_slice, place_in_group, seeded_order
from callgrain.plans.registry import query
from callgrain.sources.tables import table

_R = "r AS (SELECT rec_id, true_class, md5('42' || rec_id::VARCHAR) AS o, row_number() OVER (PARTITION BY true_class ORDER BY md5('42' || rec_id::VARCHAR)) AS place, count(*) OVER (PARTITION BY true_class) AS n FROM count_analysis WHERE true_class IS NOT NULL)"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows with their place in the random order of their class, and the size of the class."""
    t = table(spark, d, "count_analysis").where("true_class IS NOT NULL").select("rec_id", "true_class").withColumn("o", seeded_order("42", F.col("rec_id")))
    sizes = F.broadcast(t.groupBy("true_class").agg(F.count("*").alias("n")))  # a row per class
    return place_in_group(t, ["true_class"], "o", digest_slice("o")).join(sizes, "true_class")


_SPLIT = "round_even(n * 0.15, 0)"
_VAL = f"round_even((n - {_SPLIT}) * 0.15 / 0.85, 0)"
_P1 = f"WITH {_R}, p AS (SELECT *, CASE WHEN place <= {_SPLIT} THEN 'test' WHEN place <= {_SPLIT} + {_VAL} THEN 'val' ELSE 'train' END AS part FROM r)"


def parted(spark: SparkSession, d: str) -> DataFrame:
    test = F.bround(F.col("n") * 0.15, 0)
    val = F.bround((F.col("n") - test) * 0.15 / 0.85, 0)
    return ranked(spark, d).withColumn("part", F.when(F.col("place") <= test, "test").when(F.col("place") <= test + val, "val").otherwise("train"))


@query(f"{_P1} SELECT rec_id, true_class, part FROM p")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return parted(spark, d).select("rec_id", "true_class", "part")


@query(f"{_P1} SELECT true_class, count_if(part = 'train')::BIGINT AS train, count_if(part = 'val')::BIGINT AS val, count_if(part = 'test')::BIGINT AS test, round(count_if(part = 'train')::DOUBLE / count(*), 6) AS train_share FROM p GROUP BY true_class")
def split_proportions(spark: SparkSession, d: str) -> DataFrame:
    w = parted(spark, d).groupBy("true_class").pivot("part", ["train", "val", "test"]).count().na.fill(0)
    return w.select("true_class", "train", "val", "test", F.round(F.col("train") / (F.col("train") + F.col("val") + F.col("test")), 6).alias("train_share"))


_QUOTA = "greatest(1, round_even(n * 0.10, 0))"


@query(f"WITH {_R} SELECT true_class, any_value(n)::BIGINT AS full_count, count(*) AS sample_count, round(count(*)::DOUBLE / any_value(n), 4) AS rate FROM r WHERE place <= {_QUOTA} GROUP BY true_class")
def sample_quota(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of each class, one at least, halves rounded to even."""
    quota = F.greatest(F.lit(1.0), F.bround(F.col("n") * 0.10, 0))
    s = ranked(spark, d).where(F.col("place") <= quota)
    return s.groupBy("true_class").agg(F.max("n").alias("full_count"), F.count("*").alias("sample_count"), F.round(F.count("*") / F.max("n"), 4).alias("rate"))


@query(f"WITH {_R}, s AS (SELECT rec_id, true_class, md5('blind' || rec_id::VARCHAR) AS o FROM r WHERE place <= {_QUOTA}) SELECT 'H' || lpad((row_number() OVER (ORDER BY o))::VARCHAR, 8, '0') AS blind_id, rec_id, true_class FROM s")
def blinded_key(spark: SparkSession, d: str) -> DataFrame:
    """The private key of a blinded package: neutral ids in a second random order."""
    quota = F.greatest(F.lit(1.0), F.bround(F.col("n") * 0.10, 0))
    s = ranked(spark, d).where(F.col("place") <= quota).select("rec_id", "true_class", seeded_order("blind", F.col("rec_id")).alias("o"), F.lit(1).alias("one"))
    return place_in_group(s, ["one"], "o", digest_slice("o")).select(F.concat(F.lit("H"), F.lpad(F.col("place").cast("string"), 8, "0")).alias("blind_id"), "rec_id", "true_class")


@query("WITH u AS (SELECT DISTINCT text FROM count_analysis WHERE split IN ('test', 'val') AND text IS NOT NULL), c AS (SELECT rec_id, true_class, text FROM count_analysis WHERE split = 'train' AND true_class IS NOT NULL AND text IS NOT NULL), a AS (SELECT rec_id, true_class FROM c ANTI JOIN u USING (text)) SELECT rec_id, true_class FROM (SELECT *, row_number() OVER (PARTITION BY true_class ORDER BY md5('seed' || rec_id::VARCHAR)) AS place FROM a) WHERE place <= 5")
def seed_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five seeds per class that weren't used before, in seeded order (the size of the draw is the feature)."""
    t = table(spark, d, "count_analysis").where("text IS NOT NULL").select("rec_id", "true_class", "split", F.sha2("text", 256).alias("h"))
    used = t.where("split IN ('test', 'val')").select("h").distinct()
    free = t.where("split = 'train' AND true_class IS NOT NULL").join(used, "h", "left_anti").select("rec_id", "true_class", seeded_order("seed", F.col("rec_id")).alias("o"))
    return place_in_group(free, ["true_class"], "o", digest_slice("o")).where("place <= 5").select("rec_id", "true_class")


@query("WITH c AS (SELECT t.slug, count(c.rec_id) AS n FROM taxonomy t LEFT JOIN count_analysis c ON c.true_class = t.slug GROUP BY 1), m AS (SELECT min(n) AS low FROM c) SELECT slug, n, greatest(0, least(low + 300, 2000 - n) )::BIGINT AS target, greatest(0, least(low + 300, 2000 - n) - n)::BIGINT AS needed FROM c, m")
def upsampling_quota(spark: SparkSession, d: str) -> DataFrame:
    """How many texts each class lacks: up to 300 above the smallest class, 2000 with its own at most."""
    n = table(spark, d, "count_analysis").groupBy(F.col("true_class").alias("slug")).agg(F.count("*").alias("n"))
    c = table(spark, d, "taxonomy").select("slug").join(n, "slug", "left").na.fill(0, ["n"])
    low = c.agg(F.min("n").alias("low"))
    goal = F.least(F.col("low") + 300, F.lit(2000) - F.col("n"))
    return c.join(F.broadcast(low)).select("slug", "n", F.greatest(F.lit(0), goal).cast("bigint").alias("target"), F.greatest(F.lit(0), goal - F.col("n")).cast("bigint").alias("needed"))


@query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    """A prefix by key: the feature of a bounded trial run."""
    return table(spark, d, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(100)
