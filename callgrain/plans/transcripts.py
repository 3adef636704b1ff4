"""Curation of transcripts: scores, precheck, quality gate, replies of models, resumed work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions import rules
from callgrain.functions import text as T
from callgrain.plans.registry import query
from callgrain.sources.tables import spread, table


def _count_sql(patterns: list[str], t: str = "original_text") -> str:
    one = lambda p: f"len(regexp_extract_all(coalesce({t}, ''), '(?i){p}'))".replace("'\"", "'\"")
    return "(" + " + ".join(one(p.replace("'", "''")) for p in patterns) + ")::BIGINT"


_WC = "len(regexp_extract_all(coalesce(original_text, ''), '[\\p{L}\\p{N}_]+'))::BIGINT"
_SC = "len(list_filter(regexp_split_to_array(coalesce(original_text, ''), '[.!?]+'), lambda x: trim(regexp_replace(x, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') <> ''))::BIGINT"
_HITS = f"""WITH h AS (SELECT source_file, source_path, original_text, {_WC} AS words, length(coalesce(original_text, ''))::BIGINT AS chars, {_SC} AS sentences,
 {_count_sql(rules.CTA_PATTERNS)} AS cta, {_count_sql(rules.TUTORIAL_PATTERNS)} AS tutorial, {_count_sql(rules.NARRATION_PATTERNS)} AS told, {_count_sql(rules.DIALOGUE_PATTERNS)} AS dialogue,
 len(list_distinct(regexp_extract_all(lower(coalesce(original_text, '')), '{rules.SPEAKER_LABEL}')))::BIGINT AS voices, len(regexp_extract_all(coalesce(original_text, ''), '{rules.QUOTED}'))::BIGINT AS quotes FROM filter_transcripts),
 s AS (SELECT *, round(least(CASE WHEN dialogue >= 1 THEN 0.35 ELSE 0 END + CASE WHEN dialogue >= 3 THEN 0.25 ELSE 0 END + CASE WHEN dialogue >= 6 THEN 0.2 ELSE 0 END + CASE WHEN voices >= 2 THEN 0.4 ELSE 0 END + CASE WHEN quotes >= 2 THEN 0.3 ELSE 0 END, 1.0), 4)::DOUBLE AS dialogue_score,
 round(least(CASE WHEN told >= 2 THEN 0.25 ELSE 0 END + CASE WHEN told >= 5 THEN 0.2 ELSE 0 END + CASE WHEN tutorial >= 2 THEN 0.3 ELSE 0 END + CASE WHEN tutorial >= 5 THEN 0.15 ELSE 0 END + CASE WHEN cta >= 1 THEN 0.2 ELSE 0 END + CASE WHEN told / greatest(greatest(words, 1) / 100.0, 1.0) > 3 THEN 0.1 ELSE 0 END + CASE WHEN tutorial / greatest(greatest(words, 1) / 100.0, 1.0) > 3 THEN 0.1 ELSE 0 END, 1.0), 4)::DOUBLE AS narration_score FROM h),
 c AS (SELECT *, CASE WHEN words < 80 OR chars < 500 THEN 'REJECT_TOO_SHORT' WHEN tutorial >= 4 AND dialogue_score < 0.35 THEN 'REJECT_TUTORIAL' WHEN cta >= 2 AND dialogue_score < 0.35 THEN 'REJECT_PROMOTIONAL' WHEN dialogue_score >= 0.65 AND narration_score < 0.5 THEN 'LIKELY_CONVERSATION' WHEN dialogue_score >= 0.35 THEN 'REVIEW' ELSE 'WEAK_DIALOGUE_SIGNAL' END AS outcome FROM s)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Each transcript with its counts, scores and the outcome of the precheck; null texts count as empty."""
    t, c = F.col("original_text"), F.col
    s = spread(table(spark, d, "filter_transcripts").select("source_file", "source_path", "original_text")).select("source_file", "source_path", "original_text", F.length(T.text_or_empty(t)).cast("bigint").alias("chars"), T.sentence_count(t).alias("sentences"), *[x.alias(k) for k, x in rules.signs(t).items()])
    s = s.withColumn("dialogue_score", rules.dialogue_score(c("hits"), c("voices"), c("quotes"))).withColumn("narration_score", rules.narration_score(c("words"), c("told"), c("tutorial"), c("cta")))
    return s.withColumn("outcome", rules.precheck(c("words"), c("chars"), c("tutorial"), c("cta"), c("dialogue_score"), c("narration_score")))


@query(_HITS + " SELECT source_path, words, chars, sentences, cta, tutorial, dialogue_score, narration_score, outcome FROM c")
def transcript_precheck(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("source_path", "words", "chars", "sentences", "cta", "tutorial", "dialogue_score", "narration_score", "outcome")


@query(_HITS + " SELECT outcome, count(*) AS n, count(DISTINCT source_file) AS files, round(avg(dialogue_score), 6) AS mean_dialogue FROM c GROUP BY outcome")
def precheck_summary(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"), F.round(F.avg("dialogue_score"), 6).alias("mean_dialogue"))


# the model's verdict stands in for a remote one: it follows from the counts, so that both engines can tell it
_TERMS = " OR ".join(f"contains(lower(coalesce(original_text, '')), '{t}')" for t in rules.TOPIC_TERMS)
_GATE = _HITS + f""", v AS (SELECT *, CASE WHEN dialogue_score >= 0.35 THEN 'CONVERSATION' WHEN tutorial > 0 THEN 'TUTORIAL' ELSE 'NARRATION' END AS label, least(1.0, 0.5 + dialogue_score / 2) AS confidence FROM c),
 g AS (SELECT *, CASE WHEN label <> 'CONVERSATION' THEN 'LLM_LABEL_' || label WHEN confidence < 0.75 THEN 'LOW_LLM_CONFIDENCE' WHEN words < 80 THEN 'TOO_SHORT' WHEN dialogue_score < 0.5 THEN 'PARTICIPANTS_NOT_CONFIRMED' WHEN sentences < 4 THEN 'BACK_AND_FORTH_NOT_CONFIRMED' WHEN narration_score >= 0.65 THEN 'MOSTLY_NARRATION' WHEN tutorial >= 4 THEN 'MOSTLY_TUTORIAL' WHEN NOT ({_TERMS}) THEN 'NO_CLEAR_SCAM_TERMS' ELSE 'PASSED_ALL_FILTERS' END AS reason FROM v),
 f AS (SELECT *, CASE WHEN reason IN ('LOW_LLM_CONFIDENCE', 'PARTICIPANTS_NOT_CONFIRMED', 'BACK_AND_FORTH_NOT_CONFIRMED', 'NO_CLEAR_SCAM_TERMS') THEN 'MANUAL_REVIEW' WHEN reason = 'PASSED_ALL_FILTERS' THEN 'ACCEPT_CANDIDATE' ELSE 'REJECT' END AS status FROM g)"""


def gated(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    s = scored(spark, d)
    label = F.when(c("dialogue_score") >= 0.35, "CONVERSATION").when(c("tutorial") > 0, "TUTORIAL").otherwise("NARRATION")
    v = s.withColumn("label", label).withColumn("confidence", F.least(F.lit(1.0), F.lit(0.5) + c("dialogue_score") / 2))
    gate = rules.quality_gate(c("label"), c("confidence"), c("words"), c("dialogue_score") >= 0.5, c("sentences") >= 4, c("narration_score") >= 0.65, c("tutorial") >= 4, c("original_text"))
    return v.withColumn("gate", gate).withColumn("status", c("gate.status")).withColumn("reason", c("gate.reason"))


@query(_GATE + " SELECT source_path, label, round(confidence, 6) AS confidence, status, reason FROM f")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).select("source_path", "label", F.round("confidence", 6).alias("confidence"), "status", "reason")


@query(_GATE + " SELECT source_path, source_file, words, dialogue_score, status, reason, '' AS manual_decision FROM f WHERE status IN ('ACCEPT_CANDIDATE', 'MANUAL_REVIEW')")
def manual_review(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).where(F.col("status").isin("ACCEPT_CANDIDATE", "MANUAL_REVIEW")).select("source_path", "source_file", "words", "dialogue_score", "status", "reason", F.lit("").alias("manual_decision"))


@query("SELECT source_path, det_precheck, upper(trim(det_precheck)) = 'LIKELY_CONVERSATION' AND try_cast(det_dialogue_score AS DOUBLE) >= 0.65 AS kept FROM filter_transcripts WHERE det_precheck IS NOT NULL AND det_dialogue_score IS NOT NULL")
def label_confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "filter_transcripts").where("det_precheck IS NOT NULL AND det_dialogue_score IS NOT NULL")
    return t.select("source_path", "det_precheck", ((F.upper(F.trim("det_precheck")) == "LIKELY_CONVERSATION") & (F.col("det_dialogue_score").try_cast("double") >= 0.65)).alias("kept"))


@query("WITH f AS (SELECT source_file, count(*) AS loads FROM filter_transcripts GROUP BY 1) SELECT c.rec_id, coalesce(f.loads, 0) AS loads FROM count_analysis c LEFT JOIN f ON c.filename = f.source_file")
def verdict_join(spark: SparkSession, d: str) -> DataFrame:
    """A join that must match one row at most: the right side is made unique first."""
    f = table(spark, d, "filter_transcripts").groupBy("source_file").agg(F.count("*").alias("loads"))
    c = table(spark, d, "count_analysis")
    return c.join(f, c.filename == f.source_file, "left").select("rec_id", F.coalesce("loads", F.lit(0)).cast("bigint").alias("loads"))


@query("WITH m AS (SELECT source_path, max(loaded_at) AS m FROM filter_transcripts GROUP BY 1) SELECT t.source_path, count(*) AS rows, epoch(max(loaded_at))::BIGINT AS at, max(det_precheck) AS last FROM filter_transcripts t JOIN m ON t.source_path = m.source_path AND t.loaded_at = m.m GROUP BY 1")
def last_record_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each key of an append-only log; several equally late ones count together."""
    t = table(spark, d, "filter_transcripts").where("loaded_at IS NOT NULL AND source_path IS NOT NULL")
    same = t.groupBy("source_path", "loaded_at").agg(F.count("*").alias("rows"), F.max("det_precheck").alias("last"))
    best = F.max_by(F.struct("rows", "last"), "loaded_at")
    return same.groupBy("source_path").agg(best.alias("b"), F.unix_timestamp(F.max("loaded_at")).alias("at")).select("source_path", F.col("b.rows").alias("rows"), "at", F.col("b.last").alias("last"))


@query("SELECT d.doc_id FROM documents d WHERE d.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM count_analysis c WHERE c.text = d.text)")
def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no finished row covers: what a resumed job has left to do."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.digest(F.col("text")).alias("h"))
    done = table(spark, d, "count_analysis").where("text IS NOT NULL").select(T.digest(F.col("text")).alias("h")).distinct()
    return docs.join(done, "h", "left_anti").select("doc_id")


@query("SELECT rec_id, ((length(text) - length(replace(text, 'caller:', ''))) / 7)::BIGINT AS labels, length(replace(text, 'caller:', 'Scammer:'))::BIGINT AS new_chars FROM count_analysis WHERE text IS NOT NULL")
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "count_analysis").where("text IS NOT NULL")
    return t.select("rec_id", T.count_literal(F.col("text"), "caller:").alias("labels"), F.length(F.replace("text", F.lit("caller:"), F.lit("Scammer:"))).cast("bigint").alias("new_chars"))


@query("WITH b AS (SELECT rec_id, regexp_replace(regexp_replace(trim(regexp_extract(text, '(?is)(scammer\\s*:.*)', 1), ' '), '(?i)\\bscammer\\s*:', 'Scammer:', 'g'), '(?i)\\breceiver\\s*:', 'Receiver:', 'g') AS b FROM count_analysis WHERE text IS NOT NULL) SELECT rec_id, length(b)::BIGINT AS chars FROM b WHERE b <> '' AND len(regexp_extract_all(b, '(?m)^Scammer:')) >= 3 AND len(regexp_extract_all(b, '(?m)^Receiver:')) >= 2")
def valid_dialogues(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "count_analysis").where("text IS NOT NULL").select("rec_id", T.dialogue_or_null(F.col("text")).alias("b"))
    return t.where("b IS NOT NULL").select("rec_id", F.length("b").cast("bigint").alias("chars"))


@query("WITH l AS (SELECT rec_id, unnest(regexp_split_to_array(text, '\\n')) AS line FROM count_analysis WHERE text IS NOT NULL) SELECT rec_id, count_if(regexp_matches(lower(line), '^caller:'))::BIGINT AS caller_turns, count_if(regexp_matches(lower(line), '^receiver:'))::BIGINT AS receiver_turns FROM l GROUP BY rec_id HAVING count_if(regexp_matches(lower(line), '^(caller|receiver):')) > 0")
def dialogue_turns(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    n = lambda x: F.regexp_count(low, F.lit(rf"(?m)^{x}:")).cast("bigint")
    t = table(spark, d, "count_analysis").where("text IS NOT NULL").select("rec_id", F.translate("text", "\r\u0085  ", "    ").alias("text"))
    return t.select("rec_id", n("caller").alias("caller_turns"), n("receiver").alias("receiver_turns")).where("caller_turns + receiver_turns > 0")


@query(_GATE + " SELECT kind, coalesce(value, '') AS value, count(*) AS n, count(DISTINCT source_file) AS files FROM (SELECT source_file, unnest(['precheck', 'label', 'status', 'reason']) AS kind, unnest([outcome, label, status, reason]) AS value FROM f) GROUP BY ALL")
def filter_summary(spark: SparkSession, d: str) -> DataFrame:
    """How often each outcome of the precheck, label, status and reason of the gate occurs, and in how many files."""
    g = gated(spark, d).select("source_file", F.col("outcome").alias("precheck"), "label", "status", "reason")
    long = g.unpivot("source_file", ["precheck", "label", "status", "reason"], "kind", "value")
    return long.groupBy("kind", F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"))
