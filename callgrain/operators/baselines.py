"""Lexical baseline classifiers: hashed word n-grams with balanced weights, fitted on train, scored on every split."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.functions import text as T
from callgrain.operators.similarity import word_grams
from callgrain.session import cut


def features(docs: DataFrame, text: str, size: int = 1 << 14) -> DataFrame:
    grams = docs.withColumn("grams", word_grams(T.mixed_tokens(F.col(text)), 2))
    return HashingTF(inputCol="grams", outputCol="tf", numFeatures=size).transform(grams).drop("grams")


def fit_and_predict(docs: DataFrame, text: str, label: str, split: str, kind: str = "logistic", balanced: bool = False) -> DataFrame:
    """Rows with `gold` and `pred`, of all splits, by a model fitted on the train rows.

    Rows without text, label or split are left out. The inverse document frequencies come from train alone.
    """
    # counted once: the index, the frequencies, every pass of the fitting and the scoring read them again
    rows = cut(features(docs.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(split).isNotNull()), text), "features")
    train = rows.where(F.col(split) == "train")
    index = StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip").fit(train)
    idf = IDF(inputCol="tf", outputCol="x", minDocFreq=2).fit(train)
    ready = idf.transform(index.transform(rows))
    fit = ready.where(F.col(split) == "train")
    counts = fit.groupBy("y").agg(F.count("*").alias("n_y"))
    total = counts.agg(F.sum("n_y").alias("n"), F.count("*").alias("k"))
    weight = (F.col("n") / (F.col("k") * F.col("n_y"))) if balanced else F.lit(1.0)
    fit = fit.join(F.broadcast(counts.join(F.broadcast(total)).select("y", weight.alias("weight"))), "y")  # a row per class
    n = fit.count()
    base = dict(featuresCol="x", labelCol="y", weightCol="weight")
    if kind == "logistic":
        model = LogisticRegression(**base, regParam=1 / (5 * max(n, 1)), maxIter=30, family="multinomial").fit(fit)
    else:
        model = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=1 / max(n, 1)), featuresCol="x", labelCol="y", weightCol="weight").fit(fit)
    names = F.array(*[F.lit(x) for x in index.labels])
    return model.transform(ready).select(*docs.columns, F.col(label).alias("gold"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred"))
