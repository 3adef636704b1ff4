"""Replies of outside models: reading them, meaning a class, their validity, verdicts and typed decisions.

Clients are stand-ins that answer by what a text holds, so that SQL can tell what they say.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions import text as T
from callgrain.operators import remote
from callgrain.operators.joins import left_join_once
from callgrain.plans.metrics import per_class
from callgrain.plans.registry import query
from callgrain.sources.tables import table



def _names(spark: SparkSession, d: str, column: str) -> list[str]:
    return [r[0] for r in table(spark, d, "taxonomy").orderBy("class_no").select(column).collect()]  # eight rows


_SAID = "rtrim(lower(trim(category)), '.,;:!')"
_COUNT = "((length(lower(category)) - length(replace(lower(category), replace(lower(slug), '_', ' '), ''))) / length(slug) + (length(lower(category)) - length(replace(lower(category), lower(slug), ''))) / length(slug))"


@query(
    f"""WITH s AS (SELECT DISTINCT category FROM annotator_sheets WHERE category IS NOT NULL), x AS (SELECT category, class_no, slug, lower(slug) = {_SAID} AS same, ends_with(lower(slug), {_SAID}) OR ends_with({_SAID}, lower(slug)) AS part, {_COUNT} AS k FROM s, taxonomy),
 y AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY same DESC, part DESC, CASE WHEN same OR part THEN 0 ELSE -k END, class_no) AS place FROM x) SELECT category, slug AS class FROM y WHERE place = 1"""
)
def meant_classes(spark: SparkSession, d: str) -> DataFrame:
    """What class each typed answer means: the same word, an ending, or the class named most often."""
    s = table(spark, d, "annotator_sheets").where("category IS NOT NULL").select("category").distinct()
    return s.select("category", T.nearest_class(F.col("category"), _names(spark, d, "slug")).alias("class"))


_REPLY = "WITH r AS (SELECT DISTINCT blind_id, annotator, category, submitted_at FROM annotator_sheets)"
_VALID = "EXISTS (SELECT 1 FROM taxonomy t WHERE lower(t.long_name) = lower(trim(category)))"


def replies(spark: SparkSession, d: str) -> DataFrame:
    """(blind_id, annotator, reply, category): typed answers as a model would give them, in fenced JSON."""
    r = table(spark, d, "annotator_sheets").select("blind_id", "annotator", "category", "submitted_at").distinct()
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("category").alias("label"))), F.lit("\n```"))
    return r.select("blind_id", "annotator", F.when(F.col("category").isNotNull(), reply).alias("reply"), "category")


@query(f"{_REPLY} SELECT CASE WHEN category IS NULL THEN 'empty reply' WHEN {_VALID} THEN '' ELSE 'label not allowed' END AS reason, count(*) AS n FROM r GROUP BY 1")
def reply_validity(spark: SparkSession, d: str) -> DataFrame:
    """How many replies can be read, and why the others can't."""
    p = replies(spark, d).select(T.parsed_reply(F.col("reply"), _names(spark, d, "long_name")).alias("p"))
    return p.groupBy(F.col("p.reason").alias("reason")).agg(F.count("*").alias("n"))


_M6 = f"""{_REPLY}, g AS (SELECT DISTINCT blind_id, true_class FROM compute_annotation_metrics WHERE true_class IN (SELECT long_name FROM taxonomy)), z AS (SELECT true_class AS gold, (SELECT any_value(t.long_name) FROM taxonomy t WHERE lower(t.long_name) = lower(trim(category))) AS pred FROM r JOIN g USING (blind_id)),
 x AS (SELECT t.long_name AS label, (SELECT count(*) FROM z WHERE gold = t.long_name) AS support, (SELECT count(*) FROM z WHERE gold = t.long_name AND pred = gold) AS tp, (SELECT count(*) FROM z WHERE pred = t.long_name) AS predicted FROM taxonomy t),
 y AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS rc FROM x)"""


@query(_M6 + " SELECT sum(support)::BIGINT AS n, (SELECT count(*) FROM z WHERE pred IS NULL) AS invalid, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall, round(avg(coalesce(2 * p * rc / nullif(p + rc, 0), 0)), 6) AS macro_f1 FROM y")
def scores_with_invalid(spark: SparkSession, d: str) -> DataFrame:
    """Scores of replies against the recorded class: an invalid one counts as wrong, and as no class' prediction."""
    labels = table(spark, d, "taxonomy").select(F.col("long_name").alias("label"))
    truth = table(spark, d, "compute_annotation_metrics").select("blind_id", "true_class").distinct().join(F.broadcast(labels), F.col("true_class") == F.col("label")).select("blind_id", "true_class")
    p = T.parsed_reply(F.col("reply"), _names(spark, d, "long_name"))
    z = replies(spark, d).join(truth, "blind_id").select(F.col("true_class").alias("gold"), F.when(p["valid"], p["label"]).alias("pred"), F.lit(1).alias("k"))
    m = per_class(z, ["k"], labels)
    r = lambda x, name: F.round(x, 6).alias(name)
    total = m.agg(F.sum("support").alias("n"), r(F.sum("tp") / F.sum("support"), "accuracy"), r(F.avg("precision"), "macro_precision"), r(F.avg("recall"), "macro_recall"), r(F.avg("f1"), "macro_f1"))
    return total.join(F.broadcast(z.agg(F.count_if(F.col("pred").isNull()).alias("invalid"))))


def verdict_client(text: str) -> str:
    """A stand-in for an outside model."""
    label = "CONVERSATION" if ":" in text else "NARRATION"
    fields = dict.fromkeys(remote.VERDICT_FIELDS, ":" in text) | {"label": label, "confidence": 0.75, "reason": "colons"}
    return f"```json\n{json.dumps(fields)}\n```"


_PRE = "coalesce(det_precheck, '') LIKE 'REJECT%'"


@query(f"SELECT CASE WHEN {_PRE} THEN 'REJECT' WHEN original_text IS NULL THEN 'UNCLEAR' WHEN contains(original_text, ':') THEN 'CONVERSATION' ELSE 'NARRATION' END AS llm_label, CASE WHEN {_PRE} THEN 'SKIPPED' WHEN original_text IS NULL THEN 'no text' ELSE 'OK' END AS llm_status, count(*) AS n, round(avg(CASE WHEN {_PRE} THEN 1.0 WHEN original_text IS NULL THEN 0 ELSE 0.75 END), 6) AS mean_confidence FROM filter_transcripts GROUP BY 1, 2")
def transcript_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of a model on transcripts that the precheck lets pass."""
    v = remote.transcript_verdicts(table(spark, d, "filter_transcripts"), "source_file", "original_text", "det_precheck", verdict_client)
    return v.groupBy("llm_label", "llm_status").agg(F.count("*").alias("n"), F.round(F.avg("llm_confidence"), 6).alias("mean_confidence"))


@query("WITH f AS (SELECT source_file, max(original_text) AS t FROM filter_transcripts GROUP BY 1), c AS (SELECT source_file, count(*) AS loads FROM filter_transcripts GROUP BY 1) SELECT f.source_file, loads, CASE WHEN t IS NULL THEN 'UNCLEAR' WHEN contains(t, ':') THEN 'CONVERSATION' ELSE 'NARRATION' END AS llm_label FROM c JOIN f USING (source_file)")
def joined_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each file once with its verdict; the query fails if a file stood twice on either side."""
    t = table(spark, d, "filter_transcripts")
    files = t.groupBy("source_file").agg(F.count("*").alias("loads"))
    texts = t.groupBy("source_file").agg(F.max("original_text").alias("text")).withColumn("none", F.lit(None).cast("string"))
    v = remote.transcript_verdicts(texts, "source_file", "text", "none", verdict_client).select(F.col("key").alias("source_file"), "llm_label")
    return left_join_once(files, v, "source_file").select("source_file", "loads", "llm_label")


def decision_client(text: str) -> dict:
    """A stand-in for an outside model."""
    p = 0.9 if "rupee" in text.lower() else 0.6
    return {"choice": "Payment" if p > 0.8 else "OTHER", "confidence": p, "probabilities": {"payment": p if p > 0.8 else 1 - p, "other": 1 - p if p > 0.8 else p}, "latency": len(text) / 1000}


@query("SELECT CASE WHEN contains(lower(text), 'rupee') THEN 'payment' ELSE 'other' END AS label, count(*) AS n, round(avg(CASE WHEN contains(lower(text), 'rupee') THEN 0.9 ELSE 0.6 END), 6) AS mean_confidence, round(avg(CASE WHEN contains(lower(text), 'rupee') THEN 0.9 ELSE 0.4 END), 6) AS mean_payment, round(avg(length(text) / 1000), 6) AS mean_latency FROM documents WHERE text IS NOT NULL GROUP BY 1")
def typed_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Typed decisions with the probability of each class, and how long they took on average."""
    got = remote.typed_decisions(table(spark, d, "documents"), "doc_id", "text", decision_client, ["payment", "other"])
    r = lambda x, name: F.round(F.avg(x), 6).alias(name)
    return got.where("error IS NULL").groupBy("label").agg(F.count("*").alias("n"), r("confidence", "mean_confidence"), r(F.col("probabilities")["payment"], "mean_payment"), r("latency", "mean_latency"))


@query("SELECT source_file, CASE WHEN EXISTS (SELECT 1 FROM count_analysis c WHERE c.filename = source_file) THEN source_file END AS path FROM (SELECT DISTINCT trim(source_file) AS source_file FROM filter_transcripts WHERE source_file IS NOT NULL)")
def found_files(spark: SparkSession, d: str) -> DataFrame:
    """Where the file of each transcript lies among the corpus' file names; null if it is missing."""
    from callgrain.operators.joins import by_path

    files = table(spark, d, "count_analysis").where("filename IS NOT NULL").select(F.col("filename").alias("path")).distinct()
    wanted = table(spark, d, "filter_transcripts").where("source_file IS NOT NULL").select(F.col("source_file").alias("source"))
    return by_path(wanted, files).select(F.col("source").alias("source_file"), "path")


@query()
def padded_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Per split: how many ids texts have, and how many are cut at 512."""
    from callgrain.operators.bpe import padded

    c = table(spark, d, "count_analysis").where("rec_id IS NOT NULL")
    p = padded(c, "rec_id", "text").select("id", "n_tokens", "truncated", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("real"))
    return p.join(c.select(F.col("rec_id").alias("id"), "split"), "id").groupBy("split").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.count_if("truncated").alias("truncated"), F.sum("real").alias("kept"))


@query()
def fertility_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen measures of a tokenizer on the external split against those on test."""
    from callgrain.operators.bpe import fertility, padded
    from callgrain.plans.vocabulary import unseen_per_text

    docs = table(spark, d, "count_analysis").where("split IN ('test', 'external')")
    whole = padded(docs, "rec_id", "text", 8).select("id", F.col("n_tokens").alias("raw"))
    f = fertility(docs, "rec_id", "text").join(whole, "id").join(docs.select(F.col("rec_id").alias("id"), "split"), "id").join(unseen_per_text(spark, d).select(F.col("rec_id").alias("id"), "oov"), "id", "left").na.fill(0, ["oov"])
    pct = lambda k: F.avg((F.col("raw") + 2 > k).cast("double") * 100)
    measures = {
        "mean_pieces_per_word": F.avg("fertility"), **{f"split_ge_{k}_rate_mean": F.avg(100 * F.col(f"split_{k}_share")) for k in (2, 3, 4)}, "expansion_ratio_mean": F.avg(T.ratio(F.col("raw"), F.col("n_words"))),
        "mean_tokens_raw": F.avg("raw"), "p95_tokens_raw": F.percentile("raw", F.lit(0.95)), "oov_rate_mean": F.avg(100 * T.ratio(F.col("oov"), F.col("n_words"))), "unknown_rate_mean": F.avg(F.lit(0.0)),  # bytes leave nothing unknown
        **{f"pct_over_{k}": pct(k) for k in (512, 1024, 2048, 4096, 8192)},
    }
    per = f.groupBy("split").agg(*(x.alias(name) for name, x in measures.items()))
    long = per.unpivot("split", list(measures), "metric", "value")
    v = lambda s: F.round(F.max(F.when(F.col("split") == s, F.col("value"))), 6)
    return long.groupBy("metric").agg(v("test").alias("test_value"), v("external").alias("external_value")).withColumn("delta", F.round(F.col("external_value") - F.col("test_value"), 6))
