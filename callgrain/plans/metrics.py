"""Classification metrics, agreement of annotators and contingency statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions import rules
from callgrain.functions.text import ratio
from callgrain.plans.registry import query
from callgrain.sources.tables import table


def _cat(c: str) -> str:
    ladder = " ".join("WHEN " + " OR ".join(f"contains(lower(trim({c})), '{w}')" for w in words) + f" THEN '{no}'" for no, words in rules.CATEGORY_WORDS)
    return f"CASE WHEN {c} IS NULL THEN 'Missing' WHEN lower(trim({c})) = 'no scam' THEN 'No Scam' WHEN regexp_matches(trim({c}), '^[1-8]\\b') THEN left(trim({c}), 1) {ladder} ELSE 'Unknown' END"


def _conf(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('high', 'medium', 'low') THEN upper(left(trim({c}), 1)) || lower(substr(trim({c}), 2)) ELSE 'Unknown' END"


def _real(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN contains(lower({c}), 'somewhat') THEN 2 WHEN contains(lower({c}), 'not realistic') OR contains(lower({c}), 'not realisitic') OR contains(lower({c}), 'artificial') OR contains(lower({c}), 'generated') THEN 1 WHEN contains(lower({c}), 'realistic') THEN 3 END"


_A = f"WITH a AS (SELECT DISTINCT blind_id, source_dataset AS source, {_cat('true_class')} AS gold, {_cat('a1_cat')} AS a1, {_cat('a2_cat')} AS a2, {_conf('a1_conf')} AS c1, {_conf('a2_conf')} AS c2, {_real('a1_real')} AS r1, {_real('a2_real')} AS r2 FROM compute_annotation_metrics)"
_P = _A + ", p AS (SELECT '1' AS annotator, source, gold, a1 AS pred, c1 AS conf, r1 AS realism FROM a WHERE gold IN ('1','2','3','4','5','6','7','8') UNION ALL SELECT '2', source, gold, a2, c2, r2 FROM a WHERE gold IN ('1','2','3','4','5','6','7','8')), z AS (SELECT annotator, 'All' AS scope, gold, pred, conf, realism FROM p UNION ALL SELECT annotator, source, gold, pred, conf, realism FROM p)"
CLASSES = [str(i) for i in range(1, 9)]


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """One row per item: normalised answers of the first two annotators; repeated rows count once."""
    t, c = table(spark, d, "compute_annotation_metrics"), F.col
    return t.select(
        "blind_id", c("source_dataset").alias("source"), rules.category(c("true_class")).alias("gold"), rules.category(c("a1_cat")).alias("a1"), rules.category(c("a2_cat")).alias("a2"),
        rules.confidence(c("a1_conf")).alias("c1"), rules.confidence(c("a2_conf")).alias("c2"), rules.realism(c("a1_real")).alias("r1"), rules.realism(c("a2_real")).alias("r2"),
    ).distinct()


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """A row per annotator, scope (all items, and each source) and item with a recorded class."""
    a = annotations(spark, d).where(F.col("gold").isin(CLASSES))
    both = F.array(*[F.struct(F.lit(k).alias("annotator"), F.col(f"a{k}").alias("pred"), F.col(f"c{k}").alias("conf"), F.col(f"r{k}").alias("realism")) for k in ("1", "2")])
    p = a.select("gold", "source", F.explode(both).alias("x"))
    return p.select("gold", F.explode(F.array(F.lit("All"), F.col("source"))).alias("scope"), "x.*")


def per_class(rows: DataFrame, keys: list[str], labels: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class of rows (keys, gold, pred); labels outside the classes never count as
    predicted, and every class has a row for each combination of keys. Zero denominators give 0."""
    g = rows.groupBy(*keys, F.col("gold").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("gold") == F.col("pred")).alias("tp"))
    p = rows.groupBy(*keys, F.col("pred").alias("label")).agg(F.count("*").alias("predicted"))
    grid = rows.select(*keys).distinct().join(F.broadcast(labels))
    x = grid.join(g, [*keys, "label"], "left").join(p, [*keys, "label"], "left").na.fill(0, ["support", "tp", "predicted"])
    pr, rc = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    x = x.withColumn("precision", pr).withColumn("recall", rc)
    return x.withColumn("f1", ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "taxonomy").select(F.col("class_no").cast("string").alias("label"))


_M = _P + """, g AS (SELECT annotator, scope, gold AS label, count(*) AS support, count(*) FILTER (WHERE gold = pred) AS tp FROM z GROUP BY ALL), q AS (SELECT annotator, scope, pred AS label, count(*) AS predicted FROM z GROUP BY ALL),
 k AS (SELECT DISTINCT annotator, scope, class_no::VARCHAR AS label FROM z, taxonomy), x AS (SELECT k.annotator, k.scope, k.label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM k LEFT JOIN g USING (annotator, scope, label) LEFT JOIN q USING (annotator, scope, label)),
 y AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall FROM x), m AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM y)"""


@query(_M + " SELECT annotator, scope, label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def annotator_per_class(spark: SparkSession, d: str) -> DataFrame:
    m = per_class(predictions(spark, d), ["annotator", "scope"], _labels(spark, d))
    return m.select("annotator", "scope", "label", "support", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(_M + " SELECT annotator, scope, sum(support)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM m GROUP BY annotator, scope")
def annotator_validity(spark: SparkSession, d: str) -> DataFrame:
    m = per_class(predictions(spark, d), ["annotator", "scope"], _labels(spark, d))
    r = lambda x, name: F.round(x, 6).alias(name)
    return m.groupBy("annotator", "scope").agg(F.sum("support").alias("n"), r(F.sum("tp") / F.sum("support"), "accuracy"), r(F.avg("precision"), "macro_precision"), r(F.avg("recall"), "macro_recall"), r(F.avg("f1"), "macro_f1"), r(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), "weighted_f1"))


@query(_P + ", k AS (SELECT a.class_no::VARCHAR AS gold, b.class_no::VARCHAR AS pred FROM taxonomy a, taxonomy b), n AS (SELECT gold, pred, count(*) AS n FROM z WHERE annotator = '1' AND scope = 'All' GROUP BY ALL) SELECT k.gold, k.pred, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0)::DOUBLE / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY k.gold), 0), 0), 6) AS share FROM k LEFT JOIN n USING (gold, pred)")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    n = predictions(spark, d).where("annotator = '1' AND scope = 'All'").groupBy("gold", "pred").agg(F.count("*").alias("n"))
    k = _labels(spark, d)
    grid = k.withColumnRenamed("label", "gold").join(F.broadcast(k.withColumnRenamed("label", "pred")))  # eight by eight
    full = grid.join(n, ["gold", "pred"], "left").na.fill(0, ["n"])
    total = full.groupBy("gold").agg(F.sum("n").alias("total"))
    return full.join(total, "gold").select("gold", "pred", "n", F.round(ratio(F.col("n"), F.col("total")), 6).alias("share"))


@query(_P + ", n AS (SELECT gold, pred, count(*) AS n FROM z WHERE annotator = '2' AND scope = 'All' AND pred IN ('1','2','3','4','5','6','7','8') GROUP BY ALL), t AS (SELECT gold, sum(n) AS total FROM n GROUP BY gold) SELECT gold, pred, n, round(n / total, 6) AS rate FROM n JOIN t USING (gold) WHERE gold <> pred ORDER BY n DESC, rate DESC, gold, pred LIMIT 10")
def top_confusions(spark: SparkSession, d: str) -> DataFrame:
    n = predictions(spark, d).where((F.col("annotator") == "2") & (F.col("scope") == "All") & F.col("pred").isin(CLASSES)).groupBy("gold", "pred").agg(F.count("*").alias("n"))
    t = n.groupBy("gold").agg(F.sum("n").alias("total"))
    x = n.join(t, "gold").where("gold <> pred").select("gold", "pred", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))
    return x.orderBy(F.desc("n"), F.desc("rate"), "gold", "pred").limit(10)


_S = _A + ", s AS (SELECT 'All' AS scope, a1, a2 FROM a UNION ALL SELECT source, a1, a2 FROM a)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return annotations(spark, d).select(F.explode(F.array(F.lit("All"), F.col("source"))).alias("scope"), "a1", "a2")


def kappa(observed, expected):
    """Cohen's kappa; null where chance alone would agree always."""
    return F.when(F.abs(1 - expected) > 1e-12, (observed - expected) / (1 - expected))


@query(_S + ", o AS (SELECT scope, count(*) AS n, avg((a1 = a2)::INT) AS po FROM s GROUP BY scope), m1 AS (SELECT scope, a1 AS c, count(*) AS n1 FROM s GROUP BY ALL), m2 AS (SELECT scope, a2 AS c, count(*) AS n2 FROM s GROUP BY ALL), e AS (SELECT scope, sum(n1 * n2) AS x FROM m1 JOIN m2 USING (scope, c) GROUP BY scope) SELECT scope, n, round(po, 6) AS agreement, round((po - x / n / n) / (1 - x / n / n), 6) AS kappa FROM o JOIN e USING (scope)")
def agreement_kappa(spark: SparkSession, d: str) -> DataFrame:
    s = _pairs(spark, d)
    o = s.groupBy("scope").agg(F.count("*").alias("n"), F.avg((F.col("a1") == F.col("a2")).cast("int")).alias("po"))
    m1, m2 = s.groupBy("scope", F.col("a1").alias("c")).agg(F.count("*").alias("n1")), s.groupBy("scope", F.col("a2").alias("c")).agg(F.count("*").alias("n2"))
    e = m1.join(m2, ["scope", "c"]).groupBy("scope").agg(F.sum(F.col("n1") * F.col("n2")).alias("x"))
    pe = F.col("x") / F.col("n") / F.col("n")
    return o.join(e, "scope").select("scope", "n", F.round("po", 6).alias("agreement"), F.round(kappa(F.col("po"), pe), 6).alias("kappa"))


@query(_S + ", b AS (SELECT scope, class_no::VARCHAR AS label, (a1 = class_no::VARCHAR)::INT AS x, (a2 = class_no::VARCHAR)::INT AS y FROM s, taxonomy), o AS (SELECT scope, label, avg((x = y)::INT) AS po, avg(x) AS px, avg(y) AS py FROM b GROUP BY ALL) SELECT scope, label, round(po, 6) AS agreement, round(CASE WHEN abs(1 - (px * py + (1 - px) * (1 - py))) > 1e-12 THEN (po - (px * py + (1 - px) * (1 - py))) / (1 - (px * py + (1 - px) * (1 - py))) END, 6) AS kappa FROM o")
def kappa_per_class(spark: SparkSession, d: str) -> DataFrame:
    b = _pairs(spark, d).join(F.broadcast(_labels(spark, d))).select("scope", "label", (F.col("a1") == F.col("label")).cast("int").alias("x"), (F.col("a2") == F.col("label")).cast("int").alias("y"))
    o = b.groupBy("scope", "label").agg(F.avg((F.col("x") == F.col("y")).cast("int")).alias("po"), F.avg("x").alias("px"), F.avg("y").alias("py"))
    pe = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    return o.select("scope", "label", F.round("po", 6).alias("agreement"), F.round(kappa(F.col("po"), pe), 6).alias("kappa"))


@query(_A + " SELECT blind_id, CASE WHEN a1 = a2 OR a1 = gold THEN a1 WHEN a2 = gold THEN a2 ELSE gold END AS label, CASE WHEN a1 = a2 THEN 'agreement' WHEN a1 = gold THEN 'first annotator' WHEN a2 = gold THEN 'second annotator' ELSE 'expert' END AS rationale FROM a")
def adjudication(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d)
    return a.select("blind_id", rules.adjudicated(F.col("a1"), F.col("a2"), F.col("gold")).alias("r")).select("blind_id", "r.label", "r.rationale")


@query(_P + " SELECT annotator, scope, conf, count(*) AS n, round(avg((gold = pred)::INT), 6) AS accuracy FROM z GROUP BY annotator, scope, conf")
def confidence_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("annotator", "scope", "conf").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"))


@query(_P + " SELECT annotator, gold, count(*) AS n, round(avg((conf = 'Low')::INT), 6) AS low_share FROM z WHERE scope = 'All' GROUP BY annotator, gold")
def low_confidence_by_class(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).where("scope = 'All'").groupBy("annotator", "gold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("conf") == "Low").cast("int")), 6).alias("low_share"))


_R = _A + ", r AS (SELECT '1' AS annotator, source, r1 AS score FROM a WHERE r1 IS NOT NULL UNION ALL SELECT '2', source, r2 FROM a WHERE r2 IS NOT NULL)"


def _realism(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(*[F.struct(F.lit(k).alias("annotator"), F.col(f"r{k}").alias("score")) for k in ("1", "2")])
    return annotations(spark, d).select("source", F.explode(both).alias("x")).select("source", "x.*").where("score IS NOT NULL")


@query(_R + " SELECT annotator, source, count_if(score = 1)::BIGINT AS not_real, count_if(score = 2)::BIGINT AS somewhat, count_if(score = 3)::BIGINT AS realistic, round(100.0 * count_if(score = 3) / count(*), 6) AS realistic_pct FROM r GROUP BY annotator, source")
def realism_crosstab(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("score") == k)
    return _realism(spark, d).groupBy("annotator", "source").agg(n(1).alias("not_real"), n(2).alias("somewhat"), n(3).alias("realistic"), F.round(F.lit(100.0) * n(3) / F.count("*"), 6).alias("realistic_pct"))


@query(_R + ", o AS (SELECT annotator, source, score, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT * FROM (SELECT DISTINCT annotator, source FROM o) JOIN (SELECT DISTINCT annotator, score FROM o) USING (annotator)), f AS (SELECT k.*, coalesce(n, 0) AS n FROM k LEFT JOIN o USING (annotator, source, score)), t AS (SELECT *, sum(n) OVER (PARTITION BY annotator, source) AS nr, sum(n) OVER (PARTITION BY annotator, score) AS nc, sum(n) OVER (PARTITION BY annotator) AS nn FROM f), x AS (SELECT annotator, round(sum((n - nr * nc / nn) * (n - nr * nc / nn) / (nr * nc / nn)), 6) AS chi2, ((count(DISTINCT source) - 1) * (count(DISTINCT score) - 1))::BIGINT AS dof, any_value(nn)::BIGINT AS n FROM t GROUP BY annotator) SELECT *, round(CASE WHEN dof = 2 THEN exp(-chi2 / 2) END, 9) AS p FROM x")
def realism_chi_square(spark: SparkSession, d: str) -> DataFrame:
    """Independence of realism and source, from the table of counts (two sources by three scores); p has a closed form at
    two degrees of freedom and is null at others."""
    o = _realism(spark, d).groupBy("annotator", "source", "score").agg(F.count("*").alias("n"))
    row, col, all_ = (o.groupBy("annotator", *k).agg(F.sum("n").alias(name)) for k, name in ((["source"], "nr"), (["score"], "nc"), ([], "nn")))
    full = row.join(col, "annotator").join(all_, "annotator").join(o, ["annotator", "source", "score"], "left").na.fill(0, ["n"])
    e = F.col("nr") * F.col("nc") / F.col("nn")
    dof = (F.count_distinct("source") - 1) * (F.count_distinct("score") - 1)
    return full.groupBy("annotator").agg(F.round(F.sum((F.col("n") - e) * (F.col("n") - e) / e), 6).alias("chi2"), dof.cast("bigint").alias("dof"), F.max("nn").alias("n")).withColumn("p", F.round(F.when(F.col("dof") == 2, F.exp(-F.col("chi2") / 2)), 9))


#: The complementary error function by a rational approximation with an error below 1.5e-7. Fixed values.
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911)


def erfc(z: Column) -> Column:
    *a, p = ERFC
    t = 1 / (1 + z * p)
    return t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4])))) * F.exp(-z * z)


_ERFC = "t * ({0} + t * ({1} + t * ({2} + t * ({3} + t * {4})))) * exp(-z * z)".format(*ERFC)


@query(_R + ", o AS (SELECT annotator, score, count_if(source = 'human_validation') AS x, count_if(source <> 'human_validation') AS y FROM r GROUP BY ALL), w AS (SELECT *, sum(y) OVER (PARTITION BY annotator ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM o), x AS (SELECT annotator, round(sum(x * (coalesce(below, 0) + 0.5 * y)), 6)::DOUBLE AS u, sum(x)::BIGINT AS n1, sum(y)::BIGINT AS n2, sum((x + y) * (x + y) * (x + y) - (x + y))::BIGINT AS ties FROM w GROUP BY annotator), sg AS (SELECT *, sqrt(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - ties::DOUBLE / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma FROM x), zz AS (SELECT *, greatest(abs(u - n1::DOUBLE * n2 / 2) - 0.5, 0) / sigma / sqrt(2) AS z FROM sg), tt AS (SELECT *, 1 / (1 + 0.3275911 * z) AS t FROM zz) SELECT annotator, u, n1, n2, ties, round(" + _ERFC + ", 6) AS p FROM tt")
def realism_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    """U of the synthetic against the other items, from the histogram of the three scores."""
    from pyspark.sql import Window

    main = F.col("source") == "human_validation"
    o = _realism(spark, d).groupBy("annotator", "score").agg(F.count_if(main).alias("x"), F.count_if(~main).alias("y"))
    below = F.coalesce(F.sum("y").over(Window.partitionBy("annotator").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = F.col("x") + F.col("y")
    w = o.withColumn("below", below)
    u = w.groupBy("annotator").agg(F.round(F.sum(F.col("x") * (F.col("below") + F.col("y") * 0.5)), 6).alias("u"), F.sum("x").alias("n1"), F.sum("y").alias("n2"), F.sum(t * t * t - t).alias("ties"))
    c, n = F.col, F.col("n1") + F.col("n2")
    sigma = F.sqrt(c("n1").cast("double") * c("n2") / 12 * (n + 1 - c("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(c("u") - c("n1").cast("double") * c("n2") / 2) - 0.5, F.lit(0.0)) / sigma / F.sqrt(F.lit(2.0))
    return u.withColumn("p", F.round(erfc(z), 6))


def mann_whitney_p(u: float, n1: int, n2: int, ties: int) -> float:
    """Two-sided p of U, corrected for ties and continuity."""
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) if n > 1 else 0.0
    return math.erfc(max(abs(u - n1 * n2 / 2) - 0.5, 0.0) / sigma / math.sqrt(2)) if sigma else 1.0


@query("WITH c AS (SELECT true_class, count(*) AS n FROM count_analysis WHERE split = 'train' AND true_class IS NOT NULL GROUP BY 1) SELECT true_class, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "count_analysis").where("split = 'train' AND true_class IS NOT NULL").groupBy("true_class").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return c.join(F.broadcast(t)).select("true_class", "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


@query(_A + " SELECT gold AS old, a1 AS new, count(*) AS n, (gold = a1) AS stayed FROM a GROUP BY ALL")
def reclassification_moves(spark: SparkSession, d: str) -> DataFrame:
    """Old against new class: what is recorded, and what the first annotator, who read the text anew, decided."""
    a = annotations(spark, d).groupBy(F.col("gold").alias("old"), F.col("a1").alias("new")).agg(F.count("*").alias("n"))
    return a.withColumn("stayed", F.col("old") == F.col("new"))


@query("SELECT s.blind_id, count(*) AS answers FROM annotator_sheets s ANTI JOIN compute_annotation_metrics m ON s.blind_id = m.blind_id GROUP BY s.blind_id UNION ALL SELECT m.blind_id, count(*) FROM compute_annotation_metrics m WHERE true_class IS NULL GROUP BY m.blind_id")
def answers_without_truth(spark: SparkSession, d: str) -> DataFrame:
    """Items that can't be scored: on the sheets but not among the recorded ones, or recorded without a class."""
    sheets, truth = table(spark, d, "annotator_sheets"), table(spark, d, "compute_annotation_metrics")
    lost = sheets.join(truth.select("blind_id").distinct(), "blind_id", "left_anti").groupBy("blind_id").agg(F.count("*").alias("answers"))
    return lost.union(truth.where("true_class IS NULL").groupBy("blind_id").agg(F.count("*").alias("answers")))
