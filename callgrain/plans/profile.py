"""Length and class profiles of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions import text as T
from callgrain.plans.registry import query
from callgrain.session import cut
from callgrain.sources.tables import spread, table

TOK = "regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)?')"
LENGTHS = f"""SELECT rec_id, coalesce(true_class, 'none') AS true_class, len({TOK})::BIGINT AS n_tokens, length(coalesce(text, ''))::BIGINT AS n_chars,
 len(list_distinct({TOK}))::BIGINT AS n_unique, coalesce(len(list_distinct({TOK}))::DOUBLE / nullif(len({TOK}), 0), 0.0) AS ttr FROM count_analysis"""


def lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, characters, vocabulary and type-token ratio of each labelled document."""
    t = spread(table(spark, d, "count_analysis").select("rec_id", "true_class", "text")).select("rec_id", F.coalesce("true_class", F.lit("none")).alias("true_class"), F.length(T.text_or_empty(F.col("text"))).cast("bigint").alias("n_chars"), T.tokens(F.col("text")).alias("tok"))
    n, u = F.size("tok").cast("bigint"), F.size(F.array_distinct("tok")).cast("bigint")
    return t.select("rec_id", "true_class", n.alias("n_tokens"), "n_chars", u.alias("n_unique"), T.ratio(u, n).alias("ttr"))


def _stats(c: str) -> list[Column]:
    r = lambda x: F.round(x, 6)
    return [r(F.avg(c)).alias(f"mean_{c}"), r(F.median(c)).alias(f"median_{c}"), r(F.stddev_samp(c)).alias(f"sd_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]


def _stats_sql(c: str) -> str:
    return f"round(avg({c}), 6) AS mean_{c}, round(median({c}), 6) AS median_{c}, round(stddev_samp({c}), 6) AS sd_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}"


@query(f"WITH l AS ({LENGTHS}) SELECT true_class, count(*) AS n_docs, {_stats_sql('n_tokens')}, {_stats_sql('n_chars')}, {_stats_sql('n_unique')}, {_stats_sql('ttr').replace('min(ttr)', 'round(min(ttr), 6)').replace('max(ttr)', 'round(max(ttr), 6)')} FROM l GROUP BY true_class")
def length_by_class(spark: SparkSession, d: str) -> DataFrame:
    return lengths(spark, d).groupBy("true_class").agg(F.count("*").alias("n_docs"), *_stats("n_tokens"), *_stats("n_chars"), *_stats("n_unique"), *_stats("ttr")[:3], F.round(F.min("ttr"), 6).alias("min_ttr"), F.round(F.max("ttr"), 6).alias("max_ttr"))


_Q = "SELECT quantile_cont(n_tokens, 0.25) AS q1, quantile_cont(n_tokens, 0.75) AS q3 FROM l"
_BIN = "CASE WHEN n_tokens <= q1 THEN 'SHORT' WHEN n_tokens <= q3 THEN 'MEDIUM' ELSE 'LONG' END"


def binned(spark: SparkSession, d: str) -> DataFrame:
    """Lengths with a bin by the quartiles of the whole table (one row, joined to all)."""
    l = cut(lengths(spark, d), "lengths")  # noqa: E741  read twice, and words are found once
    q = l.agg(F.percentile("n_tokens", F.lit(0.25)).alias("q1"), F.percentile("n_tokens", F.lit(0.75)).alias("q3"))
    bin_ = F.when(F.col("n_tokens") <= F.col("q1"), "SHORT").when(F.col("n_tokens") <= F.col("q3"), "MEDIUM").otherwise("LONG")
    return l.join(F.broadcast(q)).withColumn("bin", bin_)


@query(f"WITH l AS ({LENGTHS}), q AS ({_Q}) SELECT count(*) AS n_docs, round(avg(ttr), 6) AS mean_ttr, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, {_stats_sql('n_tokens')}, count_if({_BIN} = 'SHORT')::BIGINT AS short, count_if({_BIN} = 'MEDIUM')::BIGINT AS medium, count_if({_BIN} = 'LONG')::BIGINT AS long FROM l, q")
def length_overall(spark: SparkSession, d: str) -> DataFrame:
    b = binned(spark, d)
    in_ = lambda x: F.count_if(F.col("bin") == x).alias(x.lower())
    return b.agg(F.count("*").alias("n_docs"), F.round(F.avg("ttr"), 6).alias("mean_ttr"), F.round(F.max("q1"), 6).alias("q1"), F.round(F.max("q3"), 6).alias("q3"), *_stats("n_tokens"), in_("SHORT"), in_("MEDIUM"), in_("LONG"))


@query(f"WITH l AS ({LENGTHS}), q AS ({_Q}), b AS (SELECT true_class, {_BIN} AS bin FROM l, q) SELECT true_class, count_if(bin = 'SHORT')::BIGINT AS short, count_if(bin = 'MEDIUM')::BIGINT AS medium, count_if(bin = 'LONG')::BIGINT AS long, round(100.0 * count_if(bin = 'SHORT') / count(*), 6) AS short_pct, round(100.0 * count_if(bin = 'MEDIUM') / count(*), 6) AS medium_pct, round(100.0 * count_if(bin = 'LONG') / count(*), 6) AS long_pct FROM b GROUP BY true_class")
def length_bins_by_class(spark: SparkSession, d: str) -> DataFrame:
    p = binned(spark, d).groupBy("true_class").pivot("bin", ["SHORT", "MEDIUM", "LONG"]).count().na.fill(0)
    bins = ("SHORT", "MEDIUM", "LONG")
    pct = lambda x: F.round(F.lit(100.0) * F.col(x) / sum((F.col(b) for b in bins[1:]), F.col(bins[0])), 6).alias(f"{x.lower()}_pct")
    return p.select("true_class", *(F.col(b).alias(b.lower()) for b in bins), *map(pct, bins))


@query("SELECT t.class_no, t.slug, count(c.rec_id) AS n_docs, round(count(c.rec_id)::DOUBLE / nullif((SELECT count(*) FROM count_analysis WHERE true_class IS NOT NULL), 0), 6) AS share FROM taxonomy t LEFT JOIN count_analysis c ON c.true_class = t.slug GROUP BY t.class_no, t.slug")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "count_analysis").where("true_class IS NOT NULL").groupBy("true_class").count()
    total = counts.agg(F.sum("count").alias("total"))
    grid = table(spark, d, "taxonomy").join(counts, F.col("slug") == F.col("true_class"), "left").join(F.broadcast(total))
    n = F.coalesce("count", F.lit(0)).cast("bigint")
    return grid.select("class_no", "slug", n.alias("n_docs"), F.round(F.try_divide(n.cast("double"), F.col("total")), 6).alias("share"))


@query("SELECT split, count(*) AS n, count(DISTINCT true_class) AS n_classes, count_if(text IS NULL OR trim(text) = '')::BIGINT AS n_blank FROM count_analysis GROUP BY split")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "count_analysis")
    return t.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("true_class").alias("n_classes"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("n_blank"))


@query("SELECT rec_id, regexp_replace(filename, '\\.txt$', '') AS stem, regexp_extract(filepath, '([^/]+)/[^/]*$', 1) AS folder FROM count_analysis")
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "count_analysis")
    return t.select("rec_id", F.regexp_replace("filename", r"\.txt$", "").alias("stem"), F.regexp_extract("filepath", r"([^/]+)/[^/]*$", 1).alias("folder"))


@query("SELECT coalesce(true_class, 'ALL') AS true_class, coalesce(split, 'ALL') AS split, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM count_analysis WHERE true_class IS NOT NULL AND split IS NOT NULL GROUP BY GROUPING SETS ((true_class, split), (true_class), ())")
def class_split_totals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "count_analysis").where("true_class IS NOT NULL AND split IS NOT NULL")
    g = t.groupingSets([["true_class", "split"], ["true_class"], []], "true_class", "split").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
    return g.select(F.coalesce("true_class", F.lit("ALL")).alias("true_class"), F.coalesce("split", F.lit("ALL")).alias("split"), "n", "mean_chars")


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, (len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')))::BIGINT AS n_words, CASE WHEN length(text) > 1500 THEN left(text, 690) || '\n[... ' || format('{:,}', length(text) - 1380) || ' characters left out ...]\n' || right(text, 690) ELSE text END AS state FROM documents WHERE text IS NOT NULL")
def head_tail_states(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), T.space_words(F.col("text")).alias("n_words"), T.head_and_tail(F.col("text"), 1500).alias("state"))
