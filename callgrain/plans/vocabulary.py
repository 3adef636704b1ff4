"""Vocabularies by split and class, unseen words, and token languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions import rules
from callgrain.functions import text as T
from callgrain.plans.profile import TOK
from callgrain.plans.registry import query
from callgrain.sources.tables import spread, table

ALPHA = "regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z]+')"
TOKENS_SQL = f"SELECT rec_id, split, true_class, unnest({TOK}) AS token FROM count_analysis"


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "count_analysis").select("rec_id", "split", "true_class", "text"))
    return t.select("rec_id", "split", "true_class", F.explode(T.tokens(F.col("text"))).alias("token"))


def train_vocabulary(tokens: DataFrame) -> DataFrame:
    return tokens.where("split = 'train'").select("token").distinct().withColumn("known", F.lit(True))


@query(f"SELECT token, count(*) AS n, count(DISTINCT rec_id) AS n_docs FROM ({TOKENS_SQL}) GROUP BY token ORDER BY n DESC, token LIMIT 50")
def vocabulary_top(spark: SparkSession, d: str) -> DataFrame:
    """The report of the most frequent words; ties go by the word."""
    per_doc = token_rows(spark, d).groupBy("token", "rec_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs")).orderBy(F.desc("n"), "token").limit(50)


_UNSEEN = f"WITH t AS ({TOKENS_SQL}), v AS (SELECT DISTINCT token FROM t WHERE split = 'train')"


@query(f"{_UNSEEN} SELECT t.split, t.token, count(*) AS n FROM t ANTI JOIN v USING (token) WHERE t.split <> 'train' GROUP BY t.split, t.token")
def unseen_words(spark: SparkSession, d: str) -> DataFrame:
    t = token_rows(spark, d)
    counts = t.where("split <> 'train'").groupBy("split", "token").agg(F.count("*").alias("n"))
    return counts.join(train_vocabulary(t), "token", "left_anti").select("split", "token", "n")


@query(f"""{_UNSEEN}, c AS (SELECT split, token, count(*) AS n FROM t WHERE split IS NOT NULL GROUP BY ALL)
SELECT split, sum(n)::BIGINT AS tokens, count(*) AS types, coalesce(sum(n) FILTER (WHERE v.token IS NULL), 0)::BIGINT AS oov_tokens, count_if(v.token IS NULL)::BIGINT AS oov_types,
 round(100.0 * coalesce(sum(n) FILTER (WHERE v.token IS NULL), 0) / sum(n), 6) AS oov_token_pct, round(100.0 * count_if(v.token IS NULL) / count(*), 6) AS oov_type_pct FROM c LEFT JOIN v USING (token) GROUP BY split""")
def unseen_by_split(spark: SparkSession, d: str) -> DataFrame:
    t = token_rows(spark, d)
    c = t.where("split IS NOT NULL").groupBy("split", "token").agg(F.count("*").alias("n")).join(train_vocabulary(t), "token", "left")
    new = F.col("known").isNull()
    a = c.groupBy("split").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.coalesce(F.sum(F.when(new, F.col("n"))), F.lit(0)).alias("oov_tokens"), F.count_if(new).alias("oov_types"))
    return a.select("*", F.round(F.lit(100.0) * F.col("oov_tokens") / F.col("tokens"), 6).alias("oov_token_pct"), F.round(F.lit(100.0) * F.col("oov_types") / F.col("types"), 6).alias("oov_type_pct"))


_DOC = f"""WITH d AS (SELECT rec_id, split, true_class, {TOK} AS tok FROM count_analysis), s AS (SELECT rec_id, split, true_class, len(tok)::BIGINT AS n, len(list_distinct(tok))::BIGINT AS u,
 len(list_filter(tok, lambda x: regexp_matches(x, '^[a-z]+$')))::BIGINT AS alpha, len(list_filter(tok, lambda x: regexp_matches(x, '^[0-9]+$')))::BIGINT AS digits, coalesce(list_sum(list_transform(tok, lambda x: length(x))), 0)::BIGINT AS letters FROM d)"""


def token_profile(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document: how many, distinct, of letters alone, of digits alone, and their length."""
    t = table(spark, d, "count_analysis").select("rec_id", "split", "true_class", T.tokens(F.col("text")).alias("tok"))
    size = lambda x: F.size(x).cast("bigint")
    return t.select(
        "rec_id", "split", "true_class", size("tok").alias("n"), size(F.array_distinct("tok")).alias("u"),
        size(F.filter("tok", lambda x: x.rlike("^[a-z]+$"))).alias("alpha"), size(F.filter("tok", lambda x: x.rlike("^[0-9]+$"))).alias("digits"),
        F.length(F.array_join("tok", "")).cast("bigint").alias("letters"),
    )


@query(_DOC + " SELECT rec_id, n, u, n - u AS repeated, round(coalesce(100.0 * (n - u) / nullif(n, 0), 0), 6) AS repeated_pct, round(coalesce(100.0 * alpha / nullif(n, 0), 0), 6) AS alpha_pct, round(coalesce(100.0 * digits / nullif(n, 0), 0), 6) AS digit_pct, round(coalesce(letters::DOUBLE / nullif(n, 0), 0), 6) AS mean_length FROM s")
def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    p = token_profile(spark, d)
    pct = lambda x: F.round(T.ratio(F.lit(100.0) * x, F.col("n")), 6)
    return p.select("rec_id", "n", "u", (F.col("n") - F.col("u")).alias("repeated"), pct(F.col("n") - F.col("u")).alias("repeated_pct"), pct(F.col("alpha")).alias("alpha_pct"), pct(F.col("digits")).alias("digit_pct"), F.round(T.ratio(F.col("letters"), F.col("n")), 6).alias("mean_length"))


@query(_DOC + " SELECT split, true_class, count(*) AS n_docs, round(avg(n), 6) AS mean_tokens, round(median(n), 6) AS median_tokens, round(avg(coalesce(u::DOUBLE / nullif(n, 0), 0)), 6) AS mean_ttr FROM s WHERE split IS NOT NULL AND true_class IS NOT NULL GROUP BY split, true_class")
def vocabulary_by_split_class(spark: SparkSession, d: str) -> DataFrame:
    p = token_profile(spark, d).where("split IS NOT NULL AND true_class IS NOT NULL")
    return p.groupBy("split", "true_class").agg(F.count("*").alias("n_docs"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.round(F.median("n"), 6).alias("median_tokens"), F.round(F.avg(T.ratio(F.col("u"), F.col("n"))), 6).alias("mean_ttr"))


_DELTA = "SELECT metric, round(external_value, 6) AS external_value, round(test_value, 6) AS test_value, round(external_value - test_value, 6) AS delta FROM (SELECT metric, max(value) FILTER (WHERE split = 'external') AS external_value, max(value) FILTER (WHERE split = 'test') AS test_value FROM (SELECT split, unnest(['tokens', 'types', 'alpha', 'digits']) AS metric, unnest([avg(n), avg(u), avg(alpha), avg(digits)]) AS value FROM s WHERE split IN ('test', 'external') GROUP BY split) GROUP BY metric)"


@query(f"{_DOC} {_DELTA}")
def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Means of the external split against those of test, a row per metric."""
    p = token_profile(spark, d).where("split IN ('test', 'external')").groupBy("split").agg(F.avg("n").alias("tokens"), F.avg("u").alias("types"), F.avg("alpha").alias("alpha"), F.avg("digits").alias("digits"))
    long = p.unpivot("split", ["tokens", "types", "alpha", "digits"], "metric", "value")
    w = long.groupBy("metric").agg(F.max(F.when(F.col("split") == "external", F.col("value"))).alias("e"), F.max(F.when(F.col("split") == "test", F.col("value"))).alias("t"))
    return w.select("metric", F.round("e", 6).alias("external_value"), F.round("t", 6).alias("test_value"), F.round(F.col("e") - F.col("t"), 6).alias("delta"))


_LANG = "CASE WHEN lower(split_part(lang, '-', 1)) IN ('en', 'eng', 'english') THEN 'EN' WHEN lower(split_part(lang, '-', 1)) IN ('hi', 'hin', 'hindi') THEN 'HI' END"
_MAP = f"""WITH t AS (SELECT rec_id, true_class, {_LANG} AS l, unnest({ALPHA}) AS token FROM count_analysis),
 c AS (SELECT token, count(*) FILTER (WHERE l = 'EN') AS en, count(*) FILTER (WHERE l = 'HI') AS hi FROM t WHERE l IS NOT NULL GROUP BY token),
 m AS (SELECT token, CASE WHEN en + hi < 3 THEN 'OTHER' WHEN en >= 9 * hi THEN 'EN' WHEN hi >= 9 * en THEN 'HI' ELSE 'AMB' END AS label FROM c)"""


def _alpha_rows(spark: SparkSession, d: str) -> DataFrame:
    first = F.lower(F.split_part("lang", F.lit("-"), F.lit(1)))
    lang = F.when(first.isin("en", "eng", "english"), "EN").when(first.isin("hi", "hin", "hindi"), "HI")
    return spread(table(spark, d, "count_analysis").select("rec_id", "true_class", "lang", "text")).select("rec_id", "true_class", lang.alias("l"), F.explode(T.alpha_tokens(F.col("text"))).alias("token"))


def token_languages(rows: DataFrame) -> DataFrame:
    """A language for each word, by how often it stands in texts labelled so; rare words are OTHER."""
    c = rows.where("l IS NOT NULL").groupBy("token").agg(F.count_if(F.col("l") == "EN").alias("en"), F.count_if(F.col("l") == "HI").alias("hi"))
    label = F.when(F.col("en") + F.col("hi") < 3, "OTHER").when(F.col("en") >= 9 * F.col("hi"), "EN").when(F.col("hi") >= 9 * F.col("en"), "HI").otherwise("AMB")
    return c.select("token", label.alias("label"))


@query(_MAP + ", x AS (SELECT token, count(*) AS n FROM t GROUP BY token), j AS (SELECT coalesce(label, 'OTHER') AS label, n FROM x LEFT JOIN m USING (token)) SELECT coalesce(label, 'TOTAL') AS label, sum(n)::BIGINT AS occurrences, count(*) AS types, round(100.0 * sum(n) / (SELECT sum(n) FROM j), 6) AS pct FROM j GROUP BY GROUPING SETS ((label), ())")
def token_language_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _alpha_rows(spark, d)
    x = rows.groupBy("token").agg(F.count("*").alias("n")).join(token_languages(rows), "token", "left").select(F.coalesce("label", F.lit("OTHER")).alias("label"), "n")
    g = x.groupingSets([["label"], []], "label").agg(F.sum("n").alias("occurrences"), F.count("*").alias("types"))
    total = x.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select(F.coalesce("label", F.lit("TOTAL")).alias("label"), "occurrences", "types", F.round(F.lit(100.0) * F.col("occurrences") / F.col("total"), 6).alias("pct"))


_MSG = _MAP + """, p AS (SELECT rec_id, any_value(true_class) AS true_class, count(*) AS n, count(*) FILTER (WHERE label = 'EN') AS en, count(*) FILTER (WHERE label = 'HI') AS hi, count(*) FILTER (WHERE label = 'AMB') AS amb FROM t LEFT JOIN m USING (token) GROUP BY rec_id),
 q AS (SELECT rec_id, true_class, n, en, hi, amb, CASE WHEN en * 100 >= n * 80 THEN 'ENGLISH_DOMINANT' WHEN hi * 100 >= n * 80 THEN 'HINDI_DOMINANT' WHEN en > 0 AND hi > 0 THEN 'HINGLISH_MIXED' WHEN amb * 100 >= n * 50 THEN 'AMBIGUOUS' ELSE 'OTHER_DOMINANT' END AS language FROM p)"""


def message_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _alpha_rows(spark, d)
    per = rows.groupBy("rec_id", "true_class", "token").agg(F.count("*").alias("c")).join(token_languages(rows), "token", "left")
    n_of = lambda x: F.coalesce(F.sum(F.when(F.col("label") == x, F.col("c"))), F.lit(0)).alias(x.lower())
    p = per.groupBy("rec_id", "true_class").agg(F.sum("c").alias("n"), n_of("EN"), n_of("HI"), n_of("AMB"))
    return p.withColumn("language", rules.message_language(F.col("en"), F.col("hi"), F.col("amb"), F.col("n")))


@query(_MSG + " SELECT rec_id, n, language, round(100.0 * en / n, 6) AS en_pct, round(100.0 * hi / n, 6) AS hi_pct FROM q")
def message_languages(spark: SparkSession, d: str) -> DataFrame:
    pct = lambda x: F.round(F.lit(100.0) * F.col(x) / F.col("n"), 6)
    return message_rows(spark, d).select("rec_id", "n", "language", pct("en").alias("en_pct"), pct("hi").alias("hi_pct"))


@query(_MSG + " SELECT coalesce(true_class, 'none') AS true_class, count(*) AS n_docs, round(avg(100.0 * en / n), 6) AS mean_en_pct, round(avg(100.0 * hi / n), 6) AS mean_hi_pct, round(avg(100.0 * amb / n), 6) AS mean_amb_pct, count_if(language = 'ENGLISH_DOMINANT')::BIGINT AS english, count_if(language = 'HINDI_DOMINANT')::BIGINT AS hindi, count_if(language = 'HINGLISH_MIXED')::BIGINT AS mixed FROM q GROUP BY 1")
def language_by_class(spark: SparkSession, d: str) -> DataFrame:
    of = lambda x: F.count_if(F.col("language") == x)
    return message_rows(spark, d).groupBy(F.coalesce("true_class", F.lit("none")).alias("true_class")).agg(F.count("*").alias("n_docs"), *(F.round(F.avg(F.lit(100.0) * F.col(x) / F.col("n")), 6).alias(f"mean_{x}_pct") for x in ("en", "hi", "amb")), of("ENGLISH_DOMINANT").alias("english"), of("HINDI_DOMINANT").alias("hindi"), of("HINGLISH_MIXED").alias("mixed"))


@query("WITH t AS (SELECT rec_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\x{0900}-\\x{097F}]+|[a-z0-9]+')) AS token FROM count_analysis) SELECT count(*) AS n, count(DISTINCT token) AS types, count_if(regexp_matches(token, '[\\x{0900}-\\x{097F}]'))::BIGINT AS devanagari FROM t")
def mixed_script_totals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "count_analysis").select(F.explode(T.mixed_tokens(F.col("text"))).alias("token")).where(F.col("token").rlike(r"[\x{0900}-\x{097F}a-z0-9]"))
    return t.agg(F.count("*").alias("n"), F.count_distinct("token").alias("types"), F.count_if(F.col("token").rlike(r"[\x{0900}-\x{097F}]")).alias("devanagari"))


@query(_MSG + ", t2 AS (SELECT language, count(*) AS n FROM q GROUP BY language) SELECT language, n, round(100.0 * n / (SELECT sum(n) FROM t2), 6) AS pct FROM t2")
def message_language_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many texts are in each language, and their share."""
    n = message_rows(spark, d).groupBy("language").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("language", "n", F.round(F.lit(100.0) * F.col("n") / F.col("all"), 6).alias("pct"))


_SUMMARY = f"""{_DOC}, k AS (SELECT DISTINCT token FROM ({TOKENS_SQL}) WHERE split = 'train'), o AS (SELECT rec_id, count_if(k.token IS NULL) AS oov, count(DISTINCT t.token) FILTER (WHERE k.token IS NULL) AS oov_types FROM ({TOKENS_SQL}) t LEFT JOIN k USING (token) GROUP BY rec_id),
 j AS (SELECT s.*, coalesce(oov, 0) AS oov, coalesce(oov_types, 0) AS oov_types FROM s LEFT JOIN o USING (rec_id) WHERE split IS NOT NULL)
SELECT split, count(*) AS conversations, sum(n)::BIGINT AS total_tokens, round(avg(n), 6) AS mean_tokens, round(median(n), 6) AS median_tokens, round(avg(u), 6) AS mean_unique, round(avg(coalesce(u::DOUBLE / nullif(n, 0), 0)), 6) AS mean_ttr,
 round(avg(coalesce(100.0 * oov / nullif(n, 0), 0)), 6) AS mean_oov_pct, round(avg(coalesce(100.0 * oov_types / nullif(u, 0), 0)), 6) AS mean_unique_oov_pct, round(avg(coalesce(100.0 * (u - oov_types) / nullif(u, 0), 0)), 6) AS mean_overlap_pct,
 round(avg(coalesce(100.0 * (n - u) / nullif(n, 0), 0)), 6) AS mean_repeated_pct, round(avg(coalesce(100.0 * alpha / nullif(n, 0), 0)), 6) AS mean_alpha_pct, round(avg(coalesce(100.0 * digits / nullif(n, 0), 0)), 6) AS mean_digit_pct, round(avg(coalesce(letters::DOUBLE / nullif(n, 0), 0)), 6) AS mean_length FROM j GROUP BY split"""


def unseen_per_text(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, oov, oov_types): of each text the words that no train text holds."""
    t = token_rows(spark, d)
    per = t.groupBy("rec_id", "token").agg(F.count("*").alias("c")).join(train_vocabulary(t), "token", "left_anti")
    return per.groupBy("rec_id").agg(F.sum("c").alias("oov"), F.count("*").alias("oov_types"))


@query(_SUMMARY)
def vocabulary_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per split: totals, and means over the texts of how varied their words are and how many train doesn't know."""
    j = token_profile(spark, d).where("split IS NOT NULL").join(unseen_per_text(spark, d), "rec_id", "left").na.fill(0, ["oov", "oov_types"])
    mean = lambda a, b, name, k=100.0: F.round(F.avg(T.ratio(F.lit(k) * a, b)), 6).alias(name)
    n, u = F.col("n"), F.col("u")
    return j.groupBy("split").agg(
        F.count("*").alias("conversations"), F.sum("n").alias("total_tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.round(F.median("n"), 6).alias("median_tokens"), F.round(F.avg("u"), 6).alias("mean_unique"), mean(u, n, "mean_ttr", 1.0),
        mean(F.col("oov"), n, "mean_oov_pct"), mean(F.col("oov_types"), u, "mean_unique_oov_pct"), mean(u - F.col("oov_types"), u, "mean_overlap_pct"), mean(n - u, n, "mean_repeated_pct"), mean(F.col("alpha"), n, "mean_alpha_pct"), mean(F.col("digits"), n, "mean_digit_pct"), mean(F.col("letters"), n, "mean_length", 1.0),
    )
