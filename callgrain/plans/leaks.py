"""Near-duplicate texts of the labelled corpus by TF-IDF over character 3-5-grams: train against test, pairs, clusters.

All grams of two texts and more count.

Texts that are alike after normalisation are one node, named by its smallest rec_id; copies aren't expanded into pairs.
SQL would pair every text with every other, so brute force over a fixture holds these in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgrain.functions import text as T
from callgrain.operators import cosine as C
from callgrain.operators.similarity import components
from callgrain.plans.registry import query
from callgrain.session import cut
from callgrain.sources.tables import spread, table

#: Least cosine of near duplicates. Fixed value.
NEAR = 0.9


def nodes(docs: DataFrame, text) -> tuple[DataFrame, DataFrame]:
    """(rows (rec_id, true_class, split, id), texts (id, text)) of rows that aren't blank; id names the distinct text."""
    # the normal form is written once: a filter on it would be moved below the dealing out of rows, and be taken again
    made = cut(docs.where("rec_id IS NOT NULL AND text IS NOT NULL").select("rec_id", "true_class", "split", text.alias("text")), "normal")
    keyed = made.where("trim(text) <> ''").withColumn("h", F.xxhash64("text", F.md5("text")))
    named = cut(keyed.groupBy("h").agg(F.min("rec_id").alias("id")), "named")
    rows = cut(keyed.select("rec_id", "true_class", "split", "h").join(named, "h").select("rec_id", "true_class", "split", "id"), "rows")
    # texts are read from the normal form again and again, and shuffled only if ids stand several times
    first = keyed.join(C.sent(named.select(F.col("id").alias("rec_id"))), "rec_id", "left_semi").select(F.col("rec_id").alias("id"), F.lower("text").alias("text"))  # its white space is folded already
    if keyed.groupBy("rec_id").count().where("count > 1").isEmpty():
        return rows, first
    return rows, cut(first.dropDuplicates(["id"]), "texts")


def train_test_pairs(docs: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(train_id, test_id, cosine, n_train, n_test): pairs of a text of train and one of test at the threshold or above;
    the ids are the first rows that have it, beside how many do. A text in both is a pair of its own."""
    rows, texts = nodes(docs.where("split IN ('train', 'test')"), T.fold_space(F.lower("text")))
    sides = cut(rows.groupBy("id").agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "test")), *(F.min(F.when(F.col("split") == s, F.col("rec_id"))).alias(f"{s}_id") for s in ("train", "test"))), "sides")
    found = C.cosine_join(texts, threshold, False, sides.where("n_train > 0").select("id"), sides.where("n_test > 0").select("id"))
    same = sides.where("n_train > 0 AND n_test > 0").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    train = sides.where("n_train > 0").select(F.col("id").alias("a"), "train_id", "n_train")
    test = sides.where("n_test > 0").select(F.col("id").alias("b"), "test_id", "n_test")
    return found.union(same).join(train, "a").join(test, "b").select("train_id", "test_id", F.bround("cosine", 4).alias("cosine"), "n_train", "n_test")


def near_pairs(docs: DataFrame, threshold: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(rows as of `nodes`, pairs (a, b, cosine)) over template texts."""
    rows, texts = nodes(docs, T.template_text(F.col("text")))
    return rows, C.cosine_join(texts, threshold)


@query()
def leak_cosine(spark: SparkSession, d: str) -> DataFrame:
    return train_test_pairs(spread(table(spark, d, "count_analysis")))


@query()
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct texts, the nearest first, with a class of each and whether they are of the same."""
    rows, pairs = near_pairs(spread(table(spark, d, "count_analysis")))
    cls = cut(rows.where("rec_id = id").select("id", "true_class").dropDuplicates(["id"]), "classes")
    a, b = (cls.select(F.col("id").alias(x), F.col("true_class").alias(f"class_{x}")) for x in ("a", "b"))
    out = pairs.join(a, "a").join(b, "b").select("a", "class_a", "b", "class_b", F.round("cosine", 6).alias("cosine"), F.col("class_a").eqNullSafe(F.col("class_b")).alias("same_class"))
    return out.orderBy(F.desc("cosine"), "a", "b")


@query()
def near_duplicate_cross_class(spark: SparkSession, d: str) -> DataFrame:
    """The pairs whose texts carry different classes."""
    return near_duplicate_pairs(spark, d).where("NOT same_class")


def ranked_clusters(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster_id, cluster_size, classes, rec_id): a row per document of a cluster of two and more; clusters are numbered
    from the largest, of equal ones from that with the smallest rec_id."""
    linked = components(pairs.select("a", "b")).select(F.col("node").alias("id"), "component")
    member = cut(rows.join(linked, "id", "left").select("rec_id", "true_class", F.coalesce("component", "id").alias("c")), "members")
    size = member.groupBy("c").agg(F.count("*").alias("cluster_size"), F.array_join(F.array_sort(F.collect_set("true_class")), " | ").alias("classes")).where("cluster_size > 1")
    # clusters are numbered within sizes, whose counts are added up from the largest: no task sorts all clusters of all sizes
    before = size.groupBy("cluster_size").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("cluster_size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("cluster_size").orderBy("c"))
    named = size.withColumn("place", place).join(F.broadcast(before.select("cluster_size", "before")), "cluster_size").withColumn("cluster_id", (F.col("place") + F.col("before")).cast("bigint"))
    return named.join(member.select("c", "rec_id"), "c").select("cluster_id", "cluster_size", "classes", "rec_id")


@query()
def near_duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows, pairs = near_pairs(spread(table(spark, d, "count_analysis")))
    return ranked_clusters(rows, pairs)


@query()
def stacked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Two vector spaces side by side, words (runs of one and two) and characters within words (3 to 5): each text's
    entries, and the length of what it holds of the 3000 most frequent terms of each."""
    from callgrain.operators.similarity import word_grams

    docs = spread(table(spark, d, "count_analysis")).where("rec_id IS NOT NULL AND text IS NOT NULL").select(F.col("rec_id").alias("id"), "text")
    words = docs.select("id", F.explode(word_grams(T.tokens(F.col("text")), 2)).alias("w")).groupBy("id", F.xxhash64("w").alias("term")).agg(F.count("*").cast("int").alias("tf"))
    spaces = [("word", words), ("char", C.char_gram_rows(docs, 3, 5, within_words=True))]
    out = None
    for name, grams in spaces:
        v = C.vectors(grams, max_terms=3000).select("id", F.lit(name).alias("space"), F.size("terms").cast("bigint").alias("n_terms"), F.round(F.sqrt(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))
        out = v if out is None else out.union(v)
    return out
