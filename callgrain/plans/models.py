"""Tokenizer fertility, baseline classifiers and calls of outside models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.operators.bpe import fertility
from callgrain.operators.remote import classify_rows
from callgrain.plans.metrics import per_class
from callgrain.plans.registry import query
from callgrain.sources.tables import table


@query()
def tokenizer_fertility(spark: SparkSession, d: str) -> DataFrame:
    """Per split: words, pieces a word (mean, median and 95th percentile), over-long texts."""
    t = table(spark, d, "count_analysis").where("split IS NOT NULL")
    f = fertility(t, "rec_id", "text").join(t.select(F.col("rec_id").alias("id"), "split"), "id")
    return f.groupBy("split").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.round(F.avg("fertility"), 6).alias("mean_fertility"), F.round(F.median("fertility"), 6).alias("median_fertility"), F.round(F.percentile("n_pieces", F.lit(0.95)), 6).alias("p95_pieces"), F.sum(F.col("over_512").cast("bigint")).alias("over_512"))


def _scored(spark: SparkSession, d: str, kind: str, balanced: bool) -> DataFrame:
    from callgrain.operators.baselines import fit_and_predict

    p = fit_and_predict(table(spark, d, "count_analysis").select("rec_id", "text", "true_class", "split"), "text", "true_class", "split", kind, balanced)
    m = per_class(p.select("split", "gold", "pred"), ["split"], table(spark, d, "taxonomy").select(F.col("slug").alias("label")))
    return m.groupBy("split").agg(F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"))


@query()
def baseline_logistic(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "logistic", False)


@query()
def baseline_logistic_balanced(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "logistic", True)


@query()
def baseline_linear_svm(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "svm", False)


@query()
def baseline_linear_svm_balanced(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "svm", True)


def keyword_client(texts: list[str]) -> list[str]:
    """A stand-in for an outside model."""
    return ["payment" if "rupee" in t.lower() else "other" for t in texts]


@query("SELECT CASE WHEN contains(lower(text), 'rupee') THEN 'payment' ELSE 'other' END AS label, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def remote_labels(spark: SparkSession, d: str) -> DataFrame:
    got = classify_rows(table(spark, d, "documents"), None, "doc_id", "text", keyword_client, ["payment", "other"])
    return got.where("valid").groupBy("label").agg(F.count("*").alias("n"))
